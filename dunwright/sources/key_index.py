"""Which keys a store holds: batch groups, compacted generations by hash prefix, Bloom filters.

A batch's new keys are one small group of files, named by its commit entry.  Compaction moves the groups of
committed batches into a generation, partitioned by hash prefix and sorted by key, with a Bloom filter for each
(generation, prefix).  A lookup reads the groups not yet compacted (their number is bounded), the filters of the
prefixes it holds, and then only the (generation, prefix) folders that the filters could not rule out.

A filter is split into buckets of ``_BITS`` bits; a key sets ``_PROBES`` bits of one bucket.  The manifest of a
compaction is one file, written last: a generation that is not in the newest manifest is not read, so a
compaction that failed half-way changes nothing.  Keys carry their batch, so that a batch that runs
again does not meet itself; the last batch of every stream stays uncompacted for that reason.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import text, texts

PREFIXES = 16             # of a store's life; more for larger stores
COMPACT_EVERY = 16        # batches
MOST_GENERATIONS = 8      # before all become one
_KEYS = "key string, stream string, batch_id bigint"
_BITS, _KEYS_A_BUCKET, _PROBES = 32768, 2048, 4  # bits as in Spark's bitmap functions
_KEYS_A_FILE = 5_000_000
_MANIFEST = "generation string, buckets bigint, stream string, upto bigint, version bigint"


def _probe(i: int) -> str:
    return f"pmod(xxhash64(key, {100 + i}), {_BITS})"


def _bucket(buckets: str) -> str:
    return f"pmod(xxhash64(key, 99), {buckets})"


@dataclass(frozen=True)
class Manifest:
    version: int
    generations: dict[str, int]  # with their number of filter buckets
    covered: dict[str, int]      # last compacted batch of every stream

    def uncovered(self) -> str:
        """SQL: batches that no generation holds."""
        if not self.covered:
            return "true"
        known = " or ".join(f"stream = {text(s)} and batch_id > {n}" for s, n in sorted(self.covered.items()))
        return f"({known} or stream not in ({texts(tuple(sorted(self.covered)))}))"


@dataclass(frozen=True)
class KeyIndex:
    spark: SparkSession
    root: str
    prefixes: int = PREFIXES
    compact_every: int = COMPACT_EVERY
    most_generations: int = MOST_GENERATIONS

    @property
    def _prefix(self) -> str:
        return f"cast(pmod(xxhash64(key, 98), {self.prefixes}) as int) prefix"

    def _read(self, schema: str, name: str, *paths: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(
                *(paths or [f"{self.root}/{name}"]))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def manifest(self) -> Manifest:
        rows = self._read(_MANIFEST, "manifest")
        version = rows.agg(F.max("version")).first()[0] or 0
        found = rows.filter(f"version = {version}").collect()  # a row per generation and stream
        return Manifest(version, {r.generation: r.buckets for r in found if r.generation is not None},
                        {r.stream: r.upto for r in found if r.stream is not None})

    def add(self, keys: DataFrame, stream: str, batch_id: int) -> str:
        """Write the keys (column ``key``) of a batch; the group counts once a commit entry names it."""
        group = uuid.uuid4().hex
        (keys.selectExpr("key", f"{text(stream)} stream", f"bigint({batch_id}) batch_id", self._prefix)
         .sortWithinPartitions("prefix", "key").write.parquet(f"{self.root}/recent/group={group}"))
        return group

    def _recent(self, groups: list[str]) -> DataFrame:
        schema = f"{_KEYS}, prefix int"
        if not groups:
            return self.spark.createDataFrame([], schema)
        return self._read(schema, "recent", *[f"{self.root}/recent/group={g}" for g in groups]).select(
            "key", "stream", "batch_id", "prefix")

    def _generation_rows(self, wanted: dict[str, list[int] | None]) -> DataFrame:
        """Keys of generations, of the given prefixes only."""
        parts = [f"generation = {text(g)}" + ("" if p is None else f" and prefix in ({', '.join(map(str, p))})")
                 for g, p in sorted(wanted.items())]
        return self._read(f"{_KEYS}, generation string, prefix int", "keys").filter(
            " or ".join(f"({p})" for p in parts) or "false").select("key", "stream", "batch_id", "prefix")

    def lookup(self, keys: DataFrame, commits: DataFrame, own: tuple[str, int]) -> DataFrame:
        """Stored keys among which all stored ones of ``keys`` (column ``key``) are.

        ``commits(stream, batch_id, key_group)`` are the committed batches; those of the batch ``own`` do
        not count.
        """
        manifest = self.manifest()
        stream, batch_id = own
        others = f"not (stream = {text(stream)} and batch_id = {batch_id})"
        groups = [r.key_group for r in commits.filter(manifest.uncovered()).filter(others)
                  .filter("key_group is not null").select("key_group").collect()]  # bounded by compaction
        asked = keys.selectExpr("key", self._prefix)
        held = sorted(r.prefix for r in asked.select("prefix").distinct().collect())  # at most one per prefix
        in_held = f"prefix in ({', '.join(map(str, held))})" if held else "false"
        found = [self._recent(groups).filter(in_held)]
        if manifest.generations and held:
            found.append(self._generation_rows(self._candidates(asked, manifest, in_held)))
        return reduce(DataFrame.unionByName, found).filter(others).select("key")

    def _candidates(self, asked: DataFrame, manifest: Manifest, in_held: str) -> dict[str, list[int]]:
        """The folders that may hold an asked key, by their filters."""
        generations = ", ".join(f"struct({text(g)} as generation, bigint({b}) as buckets)"
                                for g, b in sorted(manifest.generations.items()))
        probes = asked.selectExpr("key", "prefix", f"inline(array({generations}))").selectExpr(
            "prefix", "generation", f"{_bucket('buckets')} bucket", *[f"{_probe(i)} b{i}" for i in range(_PROBES)])
        filters = self._read("bucket bigint, bits binary, generation string, prefix int", "filters").filter(
            f"generation in ({texts(tuple(sorted(manifest.generations)))}) and {in_held}")
        is_set = " and ".join(
            f"(cast(conv(hex(substring(bits, int(b{i} div 8) + 1, 1)), 16, 10) as int)"
            f" & shiftleft(1, int(b{i} % 8))) <> 0" for i in range(_PROBES))
        hits = (probes.join(filters, ["generation", "prefix", "bucket"]).filter(is_set)
                .select("generation", "prefix").distinct().collect())  # at most generations x prefixes
        wanted: dict[str, list[int]] = {}
        for r in sorted(map(tuple, hits)):
            wanted.setdefault(r[0], []).append(r[1])
        return wanted

    def compact_if_due(self, commits: DataFrame) -> bool:
        """Move the groups of all committed batches but each stream's last into a generation."""
        manifest = self.manifest()
        open_batches = [tuple(r) for r in commits.filter(manifest.uncovered()).filter(
            "key_group is not null").select("stream", "batch_id", "key_group").collect()]
        last = {s: max(n for t, n, _ in open_batches if t == s) for s, _, _ in open_batches}
        moved = [b for b in open_batches if b[1] < last[b[0]]]
        if len(moved) < self.compact_every:
            return False
        merge = len(manifest.generations) >= self.most_generations
        rows = self._recent([g for _, _, g in moved])
        if merge:
            rows = rows.unionByName(self._generation_rows({g: None for g in manifest.generations}))
        covered = dict(manifest.covered)
        for s, n, _ in moved:
            covered[s] = max(n, covered.get(s, -1))
        name, buckets = self._write_generation(rows)
        kept = {} if merge else manifest.generations
        self._publish(Manifest(manifest.version + 1, {**kept, name: buckets}, covered))
        return True

    def _write_generation(self, rows: DataFrame) -> tuple[str, int]:
        n, name = rows.count(), uuid.uuid4().hex
        files = 1 + n // self.prefixes // _KEYS_A_FILE
        (rows.selectExpr("*", f"{text(name)} generation", f"pmod(xxhash64(key, 97), {files}) file")
         .repartition("prefix", "file").drop("file").sortWithinPartitions("prefix", "key")
         .write.mode("append").partitionBy("generation", "prefix").parquet(f"{self.root}/keys"))
        buckets = 1 + n // self.prefixes // _KEYS_A_BUCKET
        (self._generation_rows({name: None})
         .selectExpr("prefix", f"{_bucket(str(buckets))} bucket",
                     f"explode(array({', '.join(map(_probe, range(_PROBES)))})) bit")
         .groupBy("prefix", "bucket").agg(F.expr("bitmap_construct_agg(bit) bits"))
         .selectExpr("*", f"{text(name)} generation")
         .write.mode("append").partitionBy("generation", "prefix").parquet(f"{self.root}/filters"))
        return name, buckets

    def _publish(self, manifest: Manifest) -> None:
        rows = [(g, b, None, None) for g, b in manifest.generations.items()] \
            + [(None, None, s, n) for s, n in manifest.covered.items()]
        (self.spark.createDataFrame(rows, "generation string, buckets bigint, stream string, upto bigint")
         .coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={manifest.version}"))
