"""Dictionary lookups fitted from data (category -> code / share).

Three tiers, decided by a size check at fit time:

* <= MAP_LITERAL_MAX entries: one map literal; the transform is a projection,
  no join at all (large literals are slow to plan, so the tier is small);
* <= BROADCAST_MAX rows (counted): the fitted table is written once (reliable
  checkpoint) and broadcast-joined;
* larger: the checkpointed table is equi-joined with a shuffle on the key
  (AQE splits skewed keys).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP_LITERAL_MAX = 64
BROADCAST_MAX = 1_000_000


@dataclass
class Lookup:
    key_type: str
    value_type: str
    pairs: list | None = None        # small: [(key, value)]
    table: DataFrame | None = None   # larger: DataFrame(_k, _val), checkpointed
    broadcast: bool = False          # table row count <= BROADCAST_MAX (checked)

    @staticmethod
    def fit(table: DataFrame, key: str, value: str, key_type: str = "string",
            value_type: str = "double") -> "Lookup":
        t = table.select(F.col(key).cast(key_type).alias("_k"), F.col(value).cast(value_type).alias("_val"))
        head = t.limit(MAP_LITERAL_MAX + 1).collect()
        if len(head) <= MAP_LITERAL_MAX:
            return Lookup(key_type, value_type, pairs=[(r["_k"], r["_val"]) for r in head])
        return Lookup.from_table(t, key_type, value_type)

    @staticmethod
    def from_table(t: DataFrame, key_type: str = "string", value_type: str = "double") -> "Lookup":
        """A fitted (_k, _val) table: materialised once, broadcast only when its count is small."""
        from kiln.session import cut_lineage
        t = cut_lineage(t)
        return Lookup(key_type, value_type, table=t, broadcast=t.count() <= BROADCAST_MAX)

    @property
    def size(self) -> int:
        return len(self.pairs) if self.pairs is not None else -1

    def expr(self, key: Column) -> Column:
        """Map-literal lookup (only for the small form)."""
        if not self.pairs:
            return F.lit(None).cast(self.value_type)
        keys = F.array(*[F.lit(k).cast(self.key_type) for k, _ in self.pairs])
        vals = F.array(*[F.lit(v).cast(self.value_type) for _, v in self.pairs])
        return F.try_element_at(F.map_from_arrays(keys, vals), key.cast(self.key_type))

    def apply(self, df: DataFrame, key: Column, out: str) -> DataFrame:
        if self.pairs is not None:
            return df.withColumn(out, self.expr(key))
        tmp = df.withColumn("_lk", key.cast(self.key_type))
        right = self.table.withColumnRenamed("_k", "_lk")
        j = tmp.join(F.broadcast(right) if self.broadcast else right, "_lk", "left")
        return j.withColumnRenamed("_val", out).drop("_lk")
