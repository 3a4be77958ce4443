"""Operator 3: sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots. The bytes of every slot are aggregated,
and a map from slot to shard is edited (slots moved or swapped) until the shards hold nearly equal
bytes. Each version of the map is stored in a folder of its own; later runs edit the last one that is
stored whole instead of dealing anew, so that few rows move, and a run that changes nothing adds no version.

Only DataFrame functions touch the rows; the driver sees the map, whose size is the number of slots.

Defined cases: a null text has 0 bytes (and crc32 0); its row still counts 1. A null id is hashed
like any other value. Rows that agree in id and text share a virtual slot. An empty table gives an
empty result. Columns of the input named like an added one are replaced; working columns get fresh names.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import files, fresh, shared_dir, table

N_SHARDS = 16
N_SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """A version of the map from virtual slot to shard: ``owner[slot]`` is a shard."""

    n_slots: int = N_SLOTS
    n_shards: int = N_SHARDS
    owner: tuple[int, ...] = ()
    version: int = 0

    def __post_init__(self) -> None:
        if not self.owner:
            object.__setattr__(self, "owner", tuple(s % self.n_shards for s in range(self.n_slots)))
        if len(self.owner) != self.n_slots or not all(0 <= s < self.n_shards for s in self.owner):
            raise ValueError("a slot map gives each of its slots one of its shards")

    def rebalance(self, weight: dict[int, int], n_shards: int | None = None) -> SlotMap:
        """The next version, in which the shards' weights are nearly equal; this one, if no edit helps.

        While it helps, the heaviest shard that can gives a slot to the lightest, or swaps one with it. Each
        edit lessens the sum of squared loads, so the loop ends. Ties go to the smaller slot. The map itself is not changed.
        """
        n_shards = n_shards or self.n_shards
        owner = list(self.owner)
        inside: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
        load = [0] * n_shards
        for slot, shard in enumerate(owner):
            if shard >= n_shards:
                shard = owner[slot] = slot % n_shards
            bisect.insort(inside[shard], (weight.get(slot, 0), slot))
            load[shard] += weight.get(slot, 0)

        def nearest(items: list[tuple[int, int]], goal: float, below: int, above: int = 0) -> tuple[int, int] | None:
            at = bisect.bisect_left(items, (goal, -1))
            near = [x for x in items[max(0, at - 1) : at + 1] if above < x[0] < below]
            return min(near, key=lambda x: (abs(x[0] - goal), x[1]), default=None)

        def edit(low: int, high: int) -> tuple[float, tuple[int, int], tuple[int, int] | None] | None:
            """What brings the two shards nearest: a slot that ``high`` gives, and one that it gets for it."""
            gap = load[high] - load[low]
            move = nearest(inside[high], gap / 2, gap)
            best = (abs(move[0] - gap / 2), move, None) if move else None
            if best is None or best[0] > gap / 8:
                for back in inside[low]:
                    give = nearest(inside[high], gap / 2 + back[0], gap + back[0], back[0])
                    if give and (best is None or abs(give[0] - back[0] - gap / 2) < best[0]):
                        best = (abs(give[0] - back[0] - gap / 2), give, back)
            return best

        while True:
            order = sorted(range(n_shards), key=lambda s: (load[s], s))
            low = order[0]
            # a shard of one heavy slot has none to give: then the next heaviest does
            high, best = next(((h, e) for h in reversed(order[1:]) if (e := edit(low, h))), (low, None))
            if best is None:
                break
            _, give, back = best
            inside[high].remove(give)
            bisect.insort(inside[low], give)
            owner[give[1]] = low
            if back:
                inside[low].remove(back)
                bisect.insort(inside[high], back)
                owner[back[1]] = high
            net = give[0] - (back[0] if back else 0)
            load[high] -= net
            load[low] += net
        if tuple(owner) == self.owner and n_shards == self.n_shards:
            return self
        return SlotMap(self.n_slots, n_shards, tuple(owner), self.version + 1)

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to those under ``path``. A version that is there whole is never written again."""
        folder = f"{path}/version={self.version}"
        if not _whole(spark, folder):
            rows = ",".join(f"({slot},{shard},{self.n_shards})" for slot, shard in enumerate(self.owner))
            spark.sql(f"SELECT * FROM VALUES {rows} AS t(slot, shard, n_shards)").coalesce(1).write.mode("overwrite").parquet(folder)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """The stored map of this version, or the last one that is there whole; None without one."""
        if version is None:
            fs, at = files(spark, path)
            names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
            stored = sorted((int(x.split("=")[1]) for x in names if x.startswith("version=")), reverse=True)
            version = next((v for v in stored if _whole(spark, f"{path}/version={v}")), None)
        if version is None:
            return None
        rows = spark.read.parquet(f"{path}/version={version}").orderBy("slot").collect()  # a row a slot
        return cls(len(rows), rows[0].n_shards, tuple(r.shard for r in rows), version)


def _whole(spark: SparkSession, folder: str) -> bool:
    """Whether the folder's last writer ended."""
    fs, at = files(spark, f"{folder}/_SUCCESS")
    return fs.exists(at)


def map_folder(spark: SparkSession, name: str) -> str:
    """Where the slot map of the table of that name is kept: in the shared folder."""
    return f"{shared_dir(spark)}/slot-maps/{zlib.crc32(name.encode()):08x}"


def _lookup(values: list[int], index: Column) -> Column:
    """values[index], from a constant that the optimizer folds; there are as many values as slots."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), index + 1)


def record_slot(id_col: str, crc: Column, n_slots: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), crc), F.lit(n_slots)).cast("int")


def shard_by_slots(
    docs: DataFrame, n_shards: int | None = None, n_slots: int = N_SLOTS, slot_map: SlotMap | None = None,
    id_col: str = "doc_id", text_col: str = "text", store: str | None = None,
) -> tuple[DataFrame, SlotMap]:
    """All columns of ``docs`` and size, text_crc32, virtual_slot, shard, slot, map_version; and the map used.

    ``slot`` is the row's place in its shard, without gaps from 0: the rows that lie in the shard's
    earlier virtual slots, and then the place within its own, by id, crc and size.

    The map is ``slot_map``, or else the last one stored under ``store``, or else a uniform one of ``n_slots`` slots and
    ``n_shards`` (16) shards. It is edited until the shards are balanced, and the new version is stored. A given
    or stored map's own numbers of slots and of shards hold, the latter unless ``n_shards`` says otherwise.
    """
    spark = docs.sparkSession
    slot_map = slot_map or (store and SlotMap.load(spark, store)) or SlotMap(n_slots, n_shards or N_SHARDS)
    n_slots = slot_map.n_slots
    n = fresh(docs, "size", "crc", "slot", "at")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rec = docs.withColumns({n["size"]: F.octet_length(text).cast("long") + 1, n["crc"]: F.crc32(text.cast("binary"))})
    rec = rec.withColumn(n["slot"], record_slot(id_col, F.col(n["crc"]), n_slots))
    per_slot = rec.groupBy(n["slot"]).agg(F.sum(n["size"]).alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    slot_map = slot_map.rebalance({r[0]: r.bytes for r in per_slot}, n_shards)
    if store:
        slot_map.save(spark, store)
    rows, filled, first = {r[0]: r.rows for r in per_slot}, [0] * slot_map.n_shards, []
    for slot, shard in enumerate(slot_map.owner):
        first.append(filled[shard])
        filled[shard] += rows.get(slot, 0)
    place = F.row_number().over(W.partitionBy(n["slot"]).orderBy(id_col, n["crc"], n["size"]))
    out = rec.withColumn(n["at"], place).select(
        *[F.col(c) for c in docs.columns if c.lower() not in ("size", "text_crc32", "virtual_slot", "shard", "slot", "map_version")],
        F.col(n["size"]).alias("size"),
        F.col(n["crc"]).alias("text_crc32"),
        F.col(n["slot"]).alias("virtual_slot"),
        _lookup(list(slot_map.owner), F.col(n["slot"])).cast("int").alias("shard"),
        (_lookup(first, F.col(n["slot"])) + F.col(n["at"]) - 1).alias("slot"),
        F.lit(slot_map.version).alias("map_version"),
    )
    return out, slot_map


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, _ = shard_by_slots(docs, N_SHARDS, store=map_folder(spark, f"op3 {sf_dir}"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
