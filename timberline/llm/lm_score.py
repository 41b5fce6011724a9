"""Stupid-backoff scores from count tables partitioned by hash.

The model of a document is every other row of the table: its own n-grams are taken from the counts, so a text scores by
what the corpus says of it and not by itself (leave_out=False counts them too). A pair of words (a, b) that is left
scores count(a b) / count(a); any other alpha * count(b) / words, where words are those of the whole table. The first word
of a text scores count(word) / words. A word that nothing is left of counts as alpha. The result is the mean log10 per word.

1. Words are counted over all documents, one table partitioned by word. The most frequent (those that occur c times or
   more, where c is the least power of two that at most `listed` words reach) get a number and are broadcast with their
   counts; of the others each goes by a 62-bit hash of its own: words that share one are listed too. Where a count is
   kept changes no score, and each word and pair has its own counts at every size of the input.
2. Pairs of two of the `hot` most frequent words are counted first and broadcast, at most hot * hot numbers. A pair that
   makes up more than 1/hot of all pairs is among them, so no partition of the next step gathers a larger share.
3. All other pairs become rows, one for each pair of a document: the key (the pair's numbers, or the hash of a word that
   isn't listed), the document, how often. They meet their counts in the partition of the key: a pair its sum over the
   key, a word that isn't listed its row of the count table. A pair with such a word goes to that word; a pair of two
   goes to both, where each adds what depends on its count. Partitions are sorted by the key alone, one number, and read
   as arrays of whole keys, some 500,000 rows at a time; rows of one key are held together, a share of 1/hot at most.
4. What each row adds is summed by document. The result is in the shared folder when lm_scores returns.

Edge cases: a null or empty text has no words and a null score; repeated rows are scored each and counted each; in a
table of one row nothing is left, and all its words count as alpha; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, free_shuffles, small_batches, whole_text, written

#: What a row of the third step is: a pair of listed words; a pair with the word of its key as first, as second, as second
#: after a word that isn't listed either; the first word of a text; a document; the count of a word that isn't listed (in row).
PAIR, FIRST, SECOND, SECOND_OF_TWO, OPENING, DOCUMENT, COUNT = range(7)
#: Bits of a listed word's number; 0 is no word.
BITS = 20
#: Shuffled rows are compressed by the runs of bytes that they share, so what differs lies together and is as short as it can be.
#: code is a word's hash or the numbers of a pair's words with, above them, the LOW lowest bits of three counts: how often the
#: pair, its first and its second word are in the document; their next HIGH bits are in meta. meta has the role and, of a pair
#: with one listed word, that word's number and the counts of the pair, the word of the key and the listed word, SMALL bits
#: each. All other rows, and those with a count of more than SMALL bits, have a negative meta with the role, the first two
#: counts, PART bits each, and what is left: in sub the other word (or the document's id), in x what is taken from the
#: logarithm of a pair that is left (or what the document has already). SMALL is LOW + HIGH at most.
ROWS = "code long, meta long, row long, sub long, x double"
PART, SMALL, LOW, HIGH = 30, 13, 7, 8


#: Texts go to Python as pieces of so many bytes, so that rows alone bound a batch: Spark counts the bytes of a batch anew for
#: each row, which took longer than all else that it does with the rows of the third step.
PIECE, BATCH, UNBOUNDED = 1 << 12, 1 << 13, (1 << 31) - 1


SPACE = b" \t\n\r\x0b\x0c"
LOWERED = bytes(range(256)).lower()
IN_WORD = np.array([c not in SPACE for c in range(256)])


def words_of(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """What text.lower().split() gives for each text, one after the other, and which text each word is of."""
    whole = b" ".join(texts)
    inside = np.zeros(len(whole) + 2, bool)
    inside[1:-1] = IN_WORD[np.frombuffer(whole, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    places = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(whole.translate(LOWERED, SPACE))])
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    return words, np.repeat(np.arange(len(texts)), np.diff(np.append(np.searchsorted(starts, begins), len(starts))))


def hashed(words: pa.LargeBinaryArray) -> np.ndarray:
    """Negative numbers for words that aren't listed."""
    found = np.fromiter(map(xxhash.xxh64_intdigest, words.to_numpy(zero_copy_only=False), repeat(42)), np.uint64, len(words))
    return -1 - (found >> np.uint64(2)).astype(np.int64)


def _hashed(word: Column) -> Column:
    """The same in SQL."""
    return F.lit(-1) - F.shiftrightunsigned(F.xxhash64(word), 2)


def word_counts(texts: DataFrame, held: int = 500_000) -> DataFrame:
    """word, n over all texts. Each task sums what it has met, about `held` words at a time."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in met], pa.string()), pa.array(list(met.values()), pa.int64())], ["word", "n"])

        for b in batches:
            words = words_of(b.column(0).to_pylist())[0].dictionary_encode()
            for w, n in zip(words.dictionary.to_numpy(zero_copy_only=False), np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)).tolist()):
                met[w] = met.get(w, 0) + n
            if len(met) >= held:
                yield out()
                met.clear()
        yield out()

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pieces(text: str) -> Column:
    """Rows of the bytes of a text, PIECE at most in each."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(PIECE)), lambda at: F.substring(F.col(text), at, F.lit(PIECE)))
    return F.explode(F.when(F.length(text) <= PIECE, F.array(text)).otherwise(cut))


def whole_texts(batches, rows: int = 1000, size: int = 8 << 20) -> Iterator[tuple[np.ndarray, pa.Array, list[bytes]]]:
    """The first two columns and the whole texts of batches of pieces, up to `rows` texts or about `size` bytes together. The first
    column tells texts apart; the pieces of one follow each other."""
    firsts: list[int] = []
    seconds: list[int | None] = []
    texts: list[list[bytes]] = []
    held = 0

    def out() -> tuple[np.ndarray, pa.Array, list[bytes]]:
        return np.array(firsts, np.int64), pa.array(seconds, pa.int64()), [t[0] if len(t) == 1 else b"".join(t) for t in texts]

    for b in batches:
        for first, second, piece in zip(*(c.to_pylist() for c in b.columns)):
            if firsts and firsts[-1] == first:
                texts[-1].append(piece)
            else:
                if len(firsts) >= rows or held >= size:
                    yield out()
                    firsts, seconds, texts, held = [], [], [], 0
                firsts.append(first)
                seconds.append(second)
                texts.append([piece])
            held += len(piece)
    if firsts:
        yield out()


def _numbered(texts: list[bytes], listed: pa.LargeBinaryArray, hashes: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words of all texts, and which text each is of; for words that aren't listed their hashes, or 0."""
    words, of = words_of(texts)
    ids = pc.index_in(words, value_set=listed).fill_null(-1).to_numpy().astype(np.int64) + 1
    if hashes:
        rare = np.flatnonzero(ids == 0)
        ids[rare] = hashed(words.take(pa.array(rare)))
    return ids, of


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal rows of sorted columns start, and their lengths."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.ones(len(columns[0]), bool)
    starts[1:] = False
    for c in columns:
        starts[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(starts)
    return at, np.diff(np.append(at, len(starts)))


def _together(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that brings equal rows together, where they start in it, and how many they are. The columns are small numbers, none negative."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) > 63:
        order = np.lexsort(columns[::-1])
        return order, *_runs(*(c[order] for c in columns))
    key = np.zeros(len(columns[0]), np.int64)
    for c, n in zip(columns, bits):
        key = key << n | c
    order = np.argsort(key)
    return order, *_runs(key[order])


class _Batch:
    """The rows of some documents, as arrays."""

    def __init__(self, counts: np.ndarray, pairs: np.ndarray, total: int, alpha: float, leave_out: bool):
        self.counts, self.pairs, self.total, self.alpha, self.left = counts, pairs, total, alpha, int(leave_out)
        self.hot = len(pairs) - 1

    def rows(self, ids: np.ndarray, doc: np.ndarray, docs: int) -> list[tuple[np.ndarray, ...]]:
        """(key, sub, document, role, n, own, other, x) of each kind of row: n is how often the pair (or word) is in the document, own
        and other how often the word of the key and the other one are, x what is taken from the logarithm of a pair that is left."""
        length = np.bincount(doc, minlength=docs)
        log_words = np.log10(max(1, self.total))
        listed = ids > 0
        own = np.empty(len(ids), np.int64)  # how often each word is in its document
        which = ids.copy()  # small numbers for all words
        which[~listed] = len(self.counts) + np.unique(ids[~listed], return_inverse=True)[1]
        order, _, times = _together(doc, which)
        own[order] = np.repeat(times, times)
        here = self.counts[np.maximum(ids, 0)] - self.left * own
        log_first = np.log10(np.maximum(here, 1))  # a pair that is left leaves its first word
        back_off = np.log10(self.alpha) + np.log10(np.maximum(here, self.alpha)) - log_words
        base = np.zeros(docs)
        out = []

        opens = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        known = opens[listed[opens]]
        base[doc[known]] += back_off[known] - np.log10(self.alpha)
        known = opens[~listed[opens]]
        if len(known):
            out.append((ids[known], known * 0, doc[known], OPENING, known * 0 + 1, own[known], None, np.zeros(len(known))))

        second = np.flatnonzero(doc[1:] == doc[:-1]) + 1 if len(doc) else np.zeros(0, np.int64)
        first = second - 1
        both = np.flatnonzero(listed[first] & listed[second])
        a, b = first[both], second[both]
        key = (ids[a] << BITS) | ids[b]
        order = np.lexsort((key, doc[b])) if docs >= 1 << (63 - 2 * BITS) else np.argsort((doc[b] << (2 * BITS)) | key)
        at, times = _runs(doc[b][order], key[order])
        a, b, key = a[order[at]], b[order[at]], key[order[at]]
        base += np.bincount(doc[b], times * back_off[b], docs)  # as if none were left; what is left makes up for it
        hot = (ids[a] <= self.hot) & (ids[b] <= self.hot)
        c = self.pairs[ids[a[hot]], ids[b[hot]]] - self.left * times[hot]
        met = c > 0
        ha, hb = a[hot][met], b[hot][met]
        base += np.bincount(doc[hb], times[hot][met] * (np.log10(c[met]) - log_first[ha] - back_off[hb]), docs)
        a, b, key, times = a[~hot], b[~hot], key[~hot], times[~hot]
        out.append((key, key * 0, doc[b], PAIR, times, own[a], own[b], log_first[a] + back_off[b]))

        for role, anchor, other in ((FIRST, first, second), (SECOND, second, first)):
            place = np.flatnonzero(~listed[anchor])
            order, at, times = _together(doc[anchor[place]], which[anchor[place]], which[other[place]])
            p = place[order[at]]
            w, z = anchor[p], other[p]
            if role == FIRST:  # a listed second word's share is in the base already; another's is added at its own place
                base += np.bincount(doc[w], np.where(listed[z], times * back_off[z], 0.0), docs)
                out.append((ids[w], 2 * ids[z], doc[w], FIRST, times, own[w], np.where(listed[z], own[z], 0), np.where(listed[z], back_off[z], 0.0)))
            else:
                kind = np.where(listed[z], SECOND, SECOND_OF_TWO)
                out.append((ids[w], 2 * ids[z] + 1, doc[w], kind, times, own[w], np.where(listed[z], own[z], 0), np.where(listed[z], log_first[z], 0.0)))
        every = np.arange(docs)
        out.append((every, None, every, DOCUMENT, length, None, None, base))
        return out


def whole_keys(batches, size: int = 1 << 19) -> Iterator[list[np.ndarray]]:
    """key and the columns of ROWS, of whole keys of sorted batches, about `size` rows at a time."""
    held: list[list[np.ndarray]] = []
    n, most = 0, size

    def together() -> list[np.ndarray]:
        code, meta, *rest = map(np.concatenate, zip(*held))
        return [np.where(meta & 7 == PAIR, code & ((1 << (2 * BITS)) - 1), code), code, meta, *rest]

    for b in batches:
        held.append([c.to_numpy() for c in b.columns])
        n += b.num_rows
        if n >= most:
            columns = together()
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut:
                yield [c[:cut] for c in columns]
            held, n = [[c[cut:].copy() for c in columns[1:]]], n - cut
            most = max(size, 2 * n)
    if n:
        yield together()


class _Adds:
    """What rows of whole keys add to their documents. small: SMALL."""

    def __init__(self, counts: np.ndarray, total: int, alpha: float, leave_out: bool, small: int):
        self.counts, self.total, self.alpha, self.left, self.small = counts, max(1, total), alpha, int(leave_out), small

    def _floor(self, count: np.ndarray) -> np.ndarray:
        return np.maximum(count, self.alpha)

    def of_pairs(self, key, code, meta, x) -> tuple[np.ndarray, np.ndarray]:
        """Which rows of two listed words' pairs are left (an unseen pair's share is in the base), and what they add."""
        low, high = (1 << LOW) - 1, (1 << HIGH) - 1
        count = lambda at, code, meta: code >> (2 * BITS + at * LOW) & low | (meta >> (3 + at * HIGH) & high) << LOW
        n = count(2, code, meta)
        wide = np.flatnonzero(meta < 0)
        n[wide] = meta[wide] >> 3 & ((1 << PART) - 1)
        at, times = _runs(key)
        pair = (np.repeat(np.add.reduceat(n, at), times) if len(at) else n) - self.left * n
        seen = np.flatnonzero(pair > 0)
        key, code, meta, n, pair = key[seen], code[seen], meta[seen], n[seen], pair[seen]
        first = self.counts[key >> BITS] - self.left * count(0, code, meta)
        second = self.counts[key & ((1 << BITS) - 1)] - self.left * count(1, code, meta)
        wide = np.flatnonzero(meta < 0)
        first[wide] = 1
        adds = n * np.log10(pair / (first * self._floor(second)) * (self.total / self.alpha))
        adds[wide] = n[wide] * (np.log10(pair[wide]) - x[seen[wide]])
        return seen, adds

    def of_words(self, key, meta, row, sub, x) -> tuple[np.ndarray, np.ndarray]:
        """Which rows of words that aren't listed add something, and what."""
        counted = np.flatnonzero(meta & 7 == COUNT)
        here = np.flatnonzero((meta & 7 != COUNT) & (meta & 7 != DOCUMENT))
        if not len(here):
            return here, np.zeros(0)
        words = row[counted][np.searchsorted(key[counted], key[here])]
        key, meta, sub, x = key[here], meta[here], sub[here], x[here]
        role, wide = meta & 7, meta < 0
        field = lambda at, bits: meta >> at & ((1 << bits) - 1)
        count = lambda place: field(3 + BITS + place * self.small, self.small)
        other = np.where(wide, 0, field(3, BITS))  # the listed word
        n, own = np.where(wide, field(3, PART), count(0)), np.where(wide, field(3 + PART, PART), count(1))
        sub = np.where(wide, sub, 2 * other + (role == SECOND))
        order = np.lexsort((sub, key))
        at, times = _runs(key[order], sub[order])
        pair = np.empty_like(n)
        pair[order] = np.repeat(np.add.reduceat(n[order], at), times)
        pair -= self.left * n
        log_word, log_total, log_alpha = np.log10(self._floor(words - self.left * own)), np.log10(self.total), np.log10(self.alpha)
        rest = self.counts[other] - self.left * count(2)
        taken = np.where(role == FIRST, np.log10(self._floor(rest)) + log_alpha - log_total, np.log10(np.maximum(rest, 1)))
        seen = n * (np.log10(np.maximum(pair, 1)) - np.where(wide, x, taken))
        kinds = [role == OPENING, role == FIRST, (role == SECOND) & (pair > 0), pair > 0]
        adds = np.select(kinds, [log_word - log_total, seen - n * log_word, seen, 0.0], n * (log_word + log_alpha - log_total))
        kept = np.flatnonzero((pair > 0) | (role != FIRST))  # an unseen pair's share is in the base
        return here[kept], adds[kept]


def lm_scores(docs: DataFrame, alpha: float = 0.4, leave_out: bool = True, hot: int = 2000, listed: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, score: a row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    counted = written(word_counts(texts), "words")
    sizes = counted.groupBy((F.length(F.bin("n")) - 1).alias("power")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    total = sum(r.n for r in sizes)
    power = next(p for p in range(65) if sum(r.words for r in sizes if r.power >= p) <= listed)
    frequent = F.col("n") >= F.lit(2.0**power)
    shared_hash = counted.where(~frequent).groupBy(_hashed(F.col("word")).alias("key")).agg(F.count("*").alias("c"), F.collect_list(F.struct("word", "n")).alias("w")).where("c > 1")
    top = sorted([*counted.where(frequent).collect(), *shared_hash.select(F.inline("w")).collect()], key=lambda r: (-r.n, r.word))
    if len(top) >= 1 << BITS:
        raise ValueError("too many listed words")
    hot = min(hot, len(top))
    numbers = spark.sparkContext.broadcast(pa.array([r.word.encode() for r in top], pa.large_binary()))
    counts = spark.sparkContext.broadcast(np.array([0, *(r.n for r in top)], np.int64))

    def count_hot(batches) -> Iterator[pa.RecordBatch]:
        most, sums = numbers.value.slice(0, hot), np.zeros((hot + 1) ** 2, np.int64)
        for b in batches:
            ids, doc = _numbered(b.column(0).to_pylist(), most, hashes=False)
            if len(ids):
                a, z = ids[:-1], ids[1:]
                ok = (doc[1:] == doc[:-1]) & (a > 0) & (z > 0)
                np.add.at(sums, a[ok] * (hot + 1) + z[ok], 1)
        found = np.flatnonzero(sums)
        for at in range(0, len(found), 100_000):
            part = found[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[part])], ["pair", "n"])

    pairs = np.zeros((hot + 1) ** 2, np.int64)
    hot_counts = texts.select("text").mapInArrow(count_hot, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs[hot_counts.column("pair").to_numpy()] = hot_counts.column("n").to_numpy()
    hot_pairs = spark.sparkContext.broadcast(pairs.reshape(hot + 1, hot + 1))

    def exploded(batches) -> Iterator[pa.RecordBatch]:
        batch = _Batch(counts.value, hot_pairs.value, total, alpha, leave_out)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        names = [c.split()[0] for c in ROWS.split(", ")]
        for row, who, held in whole_texts(batches):
            ids, doc = _numbered(held, numbers.value)
            for key, sub, d, role, n, own, other, x in batch.rows(ids, doc, len(row)):
                if own is None:  # documents carry their ids; their keys only spread them
                    key, sub, own = -1 - row, who.fill_null(0).to_numpy(), who.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
                meta = np.int64(-1 << 63) | role | (n << 3) | (own << (3 + PART))
                if other is not None:
                    narrow = np.maximum(np.maximum(n, own), other) < 1 << SMALL
                    if np.ndim(role) == 0 and role == PAIR:
                        low = (1 << LOW) - 1
                        key = np.where(narrow, key | ((own & low | (other & low) << LOW | (n & low) << (2 * LOW)) << (2 * BITS)), key)
                        short = PAIR | (own >> LOW | other >> LOW << HIGH | n >> LOW << (2 * HIGH)) << 3
                    else:
                        narrow &= sub > 1  # the other word is listed
                        short = role | (sub >> 1) << 3 | (n | own << SMALL | other << (2 * SMALL)) << (3 + BITS)
                    meta, sub, x = np.where(narrow, short, meta), np.where(narrow, 0, sub), np.where(narrow, 0.0, x)
                for at in range(0, len(d), 50_000):
                    part = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[part]), k) for c, k in zip((key, meta, row[d], sub, x), kinds)], names)

    def scored(batches) -> Iterator[pa.RecordBatch]:
        adds = _Adds(counts.value, total, alpha, leave_out, SMALL)
        names = ["row", "s", "n_words", "doc_id"]
        for key, code, meta, row, sub, x in whole_keys(batches):
            pairs = int(np.searchsorted(key, 0))  # all other keys are negative
            at = np.flatnonzero(meta[:pairs] & 7 == DOCUMENT)
            n, known = meta[at] >> 3 & ((1 << PART) - 1), meta[at] >> (3 + PART) & 1
            yield pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(x[at]), pa.array(n), pa.array(sub[at], mask=known == 0)], names)
            for start, (at, s) in ((0, adds.of_words(*(c[:pairs] for c in (key, meta, row, sub, x)))), (pairs, adds.of_pairs(*(c[pairs:] for c in (key, code, meta, x))))):
                of = row[start:][at]
                for i in range(0, len(of), 50_000):
                    none = pa.nulls(len(of[i : i + 50_000]), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(of[i : i + 50_000]), pa.array(s[i : i + 50_000]), none, none], names)

    free_shuffles(spark)
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").select("row", "doc_id", pieces("text").alias("text"))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.when(F.col("meta").bitwiseAND(7) == PAIR, F.col("code").bitwiseAND((1 << (2 * BITS)) - 1)).otherwise(F.col("code"))
    others = counted.where(~frequent).select(_hashed(F.col("word")).alias("code"), F.lit((-1 << 63) | COUNT).alias("meta"), F.col("n").alias("row"), F.lit(0).cast("long").alias("sub"), F.lit(0.0).alias("x"))
    rows = numbered.mapInArrow(exploded, ROWS).union(others).repartition(n_parts, key).sortWithinPartitions(key)
    added = rows.mapInArrow(scored, "row long, s double, n_words long, doc_id long")
    sums = added.groupBy("row").agg(F.sum("s").alias("s"), F.max("n_words").alias("n_words"), F.max("doc_id").alias("doc_id"))
    result = sums.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.round(F.col("s") / F.col("n_words"), 6)).alias("score"))
    small_batches(spark, BATCH, UNBOUNDED)
    try:
        scores = written(result, "scores")
    finally:  # what is read later is bounded again
        small_batches(spark)
    dropped(spark, counted)
    return scores
