"""The URLs that a stream has met: a store in buckets behind bitmaps.

A URL's hash names a block and four bits in it. The bitmaps of all blocks (4 KB each) are a small
table of their own; a micro-batch joins its URLs with them, and only URLs whose bits are all
set are looked up, in the store's folders of just those buckets. A bitmap never misses a URL
that was added; one that was not costs an opened folder at worst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.streaming.epochs import EpochTable

#: 4,096 blocks of 32,768 bits: at four bits a URL, one lookup in a hundred is needless with 14 million URLs.
BLOCKS = 4096
BUCKETS = 64
_BITS = 32768
_HASHES = 4


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def _positions(url: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(url, F.lit(i)), F.lit(_BITS)) for i in range(1, _HASHES + 1)])


class SeenUrls:
    """Slot 0 holds what was there before the stream, slot n + 1 what its epoch n added."""

    def __init__(self, spark: SparkSession, path: str, blocks: int = BLOCKS, buckets: int = BUCKETS):
        self.blocks, self.buckets = blocks, buckets
        self.store = EpochTable(spark, f"{path}/urls", every=64)
        self.bits = EpochTable(spark, f"{path}/bits", lambda df: df.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits")))

    def add(self, slot: int, urls: DataFrame) -> None:
        """``urls`` has url."""
        rows = urls.select("url").where("url IS NOT NULL").withColumn("block", _block(F.col("url"), self.blocks))
        self.store.write(slot, rows.select("url", (F.col("block") % self.buckets).alias("bucket")), by="bucket")
        bits = rows.select("block", F.explode(_positions(F.col("url"))).alias("at"))
        self.bits.write(slot, bits.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")))

    def maybe(self, slot: int, urls: DataFrame) -> DataFrame:
        """The URLs whose bits are all set by earlier slots: url, bucket."""
        bits = self.bits.before(slot)
        rows = urls.select("url", _block(F.col("url"), self.blocks).alias("block"), _positions(F.col("url")).alias("at"))
        byte = F.conv(F.hex(F.expr("substring(bits, int(p div 8) + 1, 1)")), 16, 10).cast("int")
        hit = (rows.join(bits, "block").select("url", "block", "bits", F.explode("at").alias("p"))
               .where(F.getbit(byte, (F.col("p") % 8).cast("int")) == 1))
        return (hit.groupBy("url", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == _HASHES)
                .select("url", (F.col("block") % self.buckets).alias("bucket")))

    def met(self, slot: int, urls: DataFrame) -> tuple[DataFrame | None, list[int]]:
        """Those of the distinct ``urls`` that earlier slots hold, and the buckets that were opened."""
        store = self.store.before(slot)
        if store is None:
            return None, []
        maybe = self.maybe(slot, urls).persist()
        opened = sorted(r[0] for r in maybe.select("bucket").distinct().collect())  # ``buckets`` numbers at most
        return maybe.join(store.where(F.col("bucket").isin(opened)).select("url", "bucket"), ["url", "bucket"], "left_semi"), opened
