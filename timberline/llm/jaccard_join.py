"""N-gram Jaccard self-join on a prefix tree.

1. Every text becomes a set of hashed word n-grams. Bucket counts of all n-grams (a table of fixed size) give one
   global order, rarest first.
2. Equal sets become one class. A class's first n-grams in that order, as many as a linked set can't all lack, are
   its prefix: two linked sets share one of them.
3. Classes meet where they share a prefix n-gram. Of n-grams with the same classes one is enough, and one whose
   classes all meet elsewhere isn't needed. A place of more than `block` classes, or more n-grams than a task should
   hold, is dealt into blocks; one class of it sits in each block, so one large group of copies costs in proportion to
   its size. Classes that are connected with that one needn't meet each other again. The others meet all, dealt out as
   pairs of blocks. A class stays only where another could be linked with it: their lengths allow it, and their parity
   bitmaps differ in no more bits than linked sets can differ in n-grams.
4. At a meeting place, crowded or not, the sets go into a prefix tree (see prefix_tree).
5. The links found connect components.

Edge cases: a null or empty text has an empty set, is linked with nothing and is its own component; with fewer
words than n the whole sequence is one n-gram; repeated rows are in one class; null ids never name a component
that has another id; ties don't exist, since the threshold is compared in whole numbers; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_rows, dropped, small_batches, whole_runs, whole_text, written
from .components import components
from .prefix_tree import forest_links

BLOCKS = 256
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingles(text: str, k: int = 4) -> np.ndarray:
    """Sorted distinct hashes of the k-word n-grams of a text, A-Z lower-cased, words cut at ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=k)], np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):  # order matters: each step mixes what came before
        out = (out ^ h[i : len(words) - k + 1 + i]) * _MIX[i % 4]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _coded(n: np.ndarray) -> np.ndarray:
    """Counts as one byte each that keeps their order: exact under 128, then eight steps to each doubling."""
    return np.where(n < 128, n, np.minimum(255, 128 + np.floor(8 * np.log2(np.maximum(n, 128) / 128)))).astype(np.uint8)


def _counts(texts: DataFrame, k: int, bits: int) -> np.ndarray:
    """How many sets hold an n-gram of each bucket, over all texts, coded: 2**bits bytes, whatever the input."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        total, sets = np.zeros(1 << bits, np.uint16), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                total[(shingles(t, k) >> np.uint64(64 - bits)).astype(np.int64)] += np.uint16(1)  # two n-grams of a set in one bucket count once
                sets += 1
                if sets == 65_535:
                    yield from leave(total)
                    total[:], sets = 0, 0
        yield from leave(total)

    def leave(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, x in enumerate(total.reshape(BLOCKS, -1)):
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["block", "n"])

    def add(batches) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(n), np.uint16)
                if block in sums:
                    sums[block] += x
                else:
                    sums[block] = x.astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_coded(x).tobytes() for x in sums.values()], pa.binary())], ["block", "n"])

    schema = "block int, n binary"
    rows = texts.mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect()
    out = np.zeros((BLOCKS, (1 << bits) // BLOCKS), np.uint8)
    for r in rows:
        out[r.block] = np.frombuffer(r.n, np.uint8)
    return out.reshape(-1)


def bitmap(grams: np.ndarray, bits: int = 512) -> bytes:
    """The parity of how many n-grams fall on each bit: two sets differ in at least as many n-grams as their bitmaps in bits."""
    at = (grams % np.uint64(1_000_003)).astype(np.int64) % bits
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).tobytes()


def may_link(n: np.ndarray, maps: np.ndarray, loose: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sets have another that could be linked with them. n: lengths; maps: a row of 64-bit words each; of two that
    aren't loose nothing is asked, as they are connected already."""
    out = np.zeros(len(n), bool)
    for i in np.flatnonzero(loose):
        total = n + n[i]
        apart = np.bitwise_count(maps ^ maps[i]).sum(axis=1, dtype=np.int64)
        ok = (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i])) & (apart * (den + num) <= (den - num) * total)
        ok[i] = False
        out |= ok
        out[i] |= bool(ok.any())
    return out


def signatures(docs: DataFrame, k: int, num: int, den: int, bits: int) -> DataFrame:
    """doc_id, h, n, digest (null for an empty set), prefix, map: a row for each row of docs (doc_id, text). h: a hash of the text."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(_counts(docs.select("text"), k, bits))

    def sign(batches) -> Iterator[pa.RecordBatch]:
        counts = order.value
        for b in batches:
            n, digests, prefixes, maps = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, k)
                n.append(len(s))
                maps.append(bitmap(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                first = len(s) + (-num * len(s) // den) + 1 if len(s) else 0
                rank = counts[(s >> np.uint64(64 - bits)).astype(np.int64)]
                if first < len(s):
                    edge = np.partition(rank, first - 1)[first - 1]
                    near = s[rank <= edge]
                    rank = rank[rank <= edge]
                else:
                    near = s
                prefixes.append(near[np.lexsort((near, rank))[:first]].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(maps, pa.binary())], ["doc_id", "h", "n", "digest", "prefix", "map"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(sign, "doc_id long, h long, n long, digest binary, prefix array<long>, map binary")


#: What a row of the small side of a broadcast join takes in memory, about.
ROW_BYTES = 96


def _likely(num: int, den: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        """The rows of a place (token, i, j) of which another could be linked with."""
        for t, starts in whole_runs(batches, 3):
            n, maps, loose = t.column("n").to_numpy(), binary_rows(t.column("map")).view(np.uint64), t.column("loose").to_numpy()
            keep = np.zeros(t.num_rows, bool)
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows]):
                if z - a > 1:
                    keep[a:z] = may_link(n[a:z], maps[a:z], loose[a:z], num, den)
            yield from t.select(["token", "i", "j", "digest", "loose", "lead"]).filter(pa.array(keep)).to_batches()

    return run


def _linked(num: int, den: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        """Links (u, v) of each place, and, with its token, each class (u) that is connected with the class that leads."""
        for t, starts in whole_runs(batches, 3):
            grams, digest, loose, lead = t.column("grams").chunk(0), t.column("digest").to_pylist(), t.column("loose").to_numpy(), t.column("lead").to_numpy()
            lengths, values = np.diff(grams.offsets.to_numpy()), grams.flatten().to_numpy()
            place = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
            at = np.arange(t.num_rows)
            connected = np.where(loose, at, np.minimum.reduceat(np.where(loose, t.num_rows, at), starts)[place])
            links = forest_links(values, lengths, place, connected, num, den)
            rows = [(None, digest[a], digest[b]) for a, b in links]
            if lead.any():
                token, up = t.column("token").to_pylist(), connected.tolist()

                def root(x: int) -> int:
                    while up[x] != x:
                        up[x] = up[up[x]]
                        x = up[x]
                    return x

                for a, b in links:
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
                for first in np.flatnonzero(lead).tolist():
                    own = root(first)
                    for i in range(int(starts[place[first]]), int(starts[place[first] + 1]) if place[first] + 1 < len(starts) else t.num_rows):
                        if root(i) == own and i != first:
                            rows.append((token[i], digest[i], None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["token", "u", "v"])

    return run


def jaccard_rows(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, bits: int = 24, block: int = 256, grams: int = 1 << 20, broadcast_mb: int = 32, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, h (a hash of the text), n_shingles, component_id, root (a name of the component, null for an empty set): a row for each row of docs; and the written tables that it reads.

    block, grams: how many classes, and n-grams, meet in one block of a place; what is broadcast takes broadcast_mb at most.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    signed = written(signatures(texts, k, num, den, bits), "signed")
    classes = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"), F.any_value("map").alias("map"))
    meet = classes.select("digest", "n", F.explode("prefix").alias("token"))
    places = meet.groupBy("token").agg(F.count("*").alias("c"), F.sum("n").alias("all"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), "digest")).alias("x")).where("c > 1")
    parts = F.ceil(F.greatest(F.col("c") / block, F.col("all") / grams)).cast("int").alias("parts")
    one = places.groupBy("c", "s", "x", "all").agg(F.min("token").alias("token")).select("token", "c", parts)
    rows = written(meet.select("token", "digest").join(one, "token").select("token", "c", "parts", "digest"), "meet")
    main = rows.groupBy("digest").agg(F.max(F.struct("c", "token")).alias("m")).select("digest", F.col("m.token").alias("main"))
    spare = rows.join(main, "digest").groupBy("token").agg(F.min("main").alias("a"), F.max("main").alias("b")).where("a = b AND a != token").select("token")
    dealt = written(rows.join(spare, "token", "left_anti").select("token", "parts", "digest"), "dealt")
    named = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    facts = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.any_value("n").alias("n"), F.any_value("map").alias("map"))

    def small(side: DataFrame, count: int) -> DataFrame:
        return F.broadcast(side) if count * ROW_BYTES <= broadcast_mb << 20 else side

    def sets_of(digests: DataFrame, count: int) -> DataFrame:
        """digest, grams of some classes, from the text of one row of each."""
        wanted = small(digests.distinct().join(named, "digest").select("digest", F.col("first_id").alias("id")), count)
        chosen = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["id"])).select("digest", "text")

        def sets(batches) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(d, shingles(t, k)) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                found = [(d, s) for d, s in found if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d]  # of rows with one id, the one meant
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.binary()), pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))], ["digest", "grams"])

        return chosen.mapInArrow(sets, "digest binary, grams array<long>")

    def met(seats_: DataFrame) -> DataFrame:
        """token, u, v: what _linked finds among classes at their places (token, i, j)."""
        placed = seats_.join(facts, "digest").select("token", "i", "j", "digest", "n", "map", "loose", "lead")
        by_place = placed.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
        seats = written(by_place.mapInArrow(_likely(num, den), "token long, i int, j int, digest binary, loose boolean, lead boolean"), "seats")
        count = seats.count()
        seated = sets_of(seats.select("digest"), count).join(small(seats, count), "digest").select("token", "i", "j", "digest", "loose", "lead", "grams")
        found = written(seated.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_linked(num, den), "token long, u binary, v binary"), "links")
        dropped(spark, seats)
        return found

    lot = F.xxhash64("digest", "token")
    yes, no = F.lit(True), F.lit(False)
    crowd = dealt.where("parts > 1")
    leaders = crowd.groupBy("token", "parts").agg(F.min("digest").alias("digest"))
    own = F.pmod(lot, F.col("parts").cast("long")).cast("int")
    first = dealt.where("parts = 1").select("token", F.lit(0).alias("i"), F.lit(0).alias("j"), "digest", yes.alias("loose"), no.alias("lead"))
    first = first.unionByName(crowd.join(leaders.withColumnRenamed("digest", "leader"), ["token", "parts"]).where("digest != leader").select("token", own.alias("i"), own.alias("j"), "digest", yes.alias("loose"), no.alias("lead")))
    first = first.unionByName(leaders.select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), "digest").select("token", "i", F.col("i").alias("j"), "digest", yes.alias("loose"), yes.alias("lead")))
    found = met(first)
    edges, tables = found.where("v IS NOT NULL").select("u", "v"), [found]
    if not crowd.isEmpty():
        tied = found.where("v IS NULL").select("token", F.col("u").alias("digest"), yes.alias("tied"))
        star = crowd.join(tied.unionByName(leaders.select("token", "digest", yes.alias("tied"))).distinct(), ["token", "digest"], "left").withColumn("tied", F.coalesce("tied", no))
        star = written(star.join(facts.select("digest", "n"), "digest"), "star")
        of = lambda which: F.ceil(F.greatest(F.count(F.when(which, 1)) / block, F.sum(F.when(which, F.col("n")).otherwise(0)) / grams)).cast("int")
        sizes = star.groupBy("token").agg(of(F.col("tied")).alias("nt"), of(~F.col("tied")).alias("nl")).where("nl > 0")
        seat = F.when(F.col("tied"), F.pmod(lot, F.col("nt").cast("long"))).otherwise(F.col("nt") + F.pmod(lot, F.col("nl").cast("long"))).cast("int")
        others = F.sequence(F.when(F.col("tied"), F.col("nt")).otherwise(F.lit(0)), F.col("nt") + F.col("nl") - 1)
        blocks = star.join(sizes, "token").select("token", "digest", "tied", seat.alias("own"), F.explode(others).alias("other"))
        rest = met(blocks.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "digest", (~F.col("tied")).alias("loose"), no.alias("lead")))
        edges = edges.unionByName(rest.select("u", "v"))
        tables += [star, rest]
    linked = components(edges, roots=False)
    dropped(spark, rows, dealt, *tables)
    rooted = named.join(linked, named["digest"] == linked["node"], "left").select("digest", "first_id", F.coalesce("root", "digest").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    final = rooted.join(names, "root").select("digest", "root", "component_id")
    out = signed.select("doc_id", "h", F.col("n").alias("n_shingles"), "digest").join(final, "digest", "left")
    return out.select("doc_id", "h", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root"), [signed]


def jaccard_classes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of docs. Sets link from a similarity of num/den."""
    return jaccard_rows(docs, **how)[0].select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each component stays, with its columns: the one with the smallest id, null ids last, then by a hash of its text.

    Of repeated rows with one id and text, one stays. Empty sets are components of their own.
    """
    found, tables = jaccard_rows(docs, id_col=id_col, text_col=text_col, **how)
    group = F.coalesce("root", F.concat(F.lit("#"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.col("h").cast("string")).cast("binary"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    keys = found.groupBy(group.alias("group"), "doc_id", "h").agg(F.count("*").alias("n"))
    stay = keys.groupBy("group").agg(F.min_by(F.struct("doc_id", "h", "n"), order).alias("s"))
    stay = written(stay.select(F.col("s.doc_id").alias("stays_id"), F.col("s.h").alias("stays_h"), F.col("s.n").alias("stays_n")), "stay")
    dropped(docs.sparkSession, *tables)
    names = [f"__{c}" for c in docs.columns]  # so that no column of docs clashes
    rows = docs.toDF(*names)
    same = F.col(f"__{id_col}").cast("long").eqNullSafe(F.col("stays_id")) & (F.xxhash64(whole_text(f"__{text_col}")) == F.col("stays_h"))
    kept = rows.join(stay.where("stays_n = 1"), same, "left_semi")
    repeated = stay.where("stays_n > 1")
    if not repeated.isEmpty():
        again = rows.join(repeated, same).dropDuplicates(["stays_id", "stays_h"]).select(*names)
        kept = kept.unionByName(again)
    return kept.toDF(*docs.columns)
