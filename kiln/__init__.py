"""kiln: Spark-native tabular profiling, preparation and model selection.

Every table-size step is a Spark job. Data-dependent operators are split
into a *fit* (one fused aggregate returning small parameters) and a lazy
*transform* (plain column expressions), so the same parameters serve
training, test, new and streaming data.
"""

from kiln.session import build_session, checkpoint_dir, cut_lineage

__all__ = ["build_session", "checkpoint_dir", "cut_lineage"]
