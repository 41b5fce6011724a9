"""BPE encoding and decoding as streaming transducers.

`Merges` holds a merge list and computes its lookahead: how many symbols before the end of what has been read a token
must end so that nothing read later can change it. Two texts that begin alike are merged alike up to some place. A
merge of (a, b) moves that place back by the length of a, and only if the token before the place is a and b starts at
the place in one of the two texts; b then starts with what moved the place before. So the place moves back by no more
than the longest such chain of merges of rising rank, which one pass over the list in falling order finds. `WordStream`
takes the symbols of a word, holds at most `window` of them, merges what it holds, and emits the tokens that end before
the lookahead. No merge crosses the end of a stable token, so the rest goes on alone, and memory doesn't grow with the
word. `Decoder` turns ids back. Both hashes of a text are fed a bounded run of ids at a time, and the decoded one from
ids alone.

Every word goes through the transducer; a worker keeps what short words gave for when they are met again.

Edge cases: a null or empty text has no tokens; texts and words of any length take the same memory besides the
text itself (and its ids, where they are asked for); a list in which a token is an operand before it is made has no
bounded lookahead here, and its words leave at their ends; rows are independent, so repeated rows repeat; other columns
are ignored.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import itertools
import json
import unicodedata
from collections.abc import Iterable, Iterator

import regex

#: Fixed value: Unicode's White_Space, what \s is for the vocabulary's own pattern.
SPACE = r"\t-\r \x85\xa0  -     　"


@functools.cache
def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Merges:
    """ranks: (left, right) -> rank; vocab: symbol -> id."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.vocab, self.end = vocab, end
        self.ranks = {pair: i for i, pair in enumerate(merges)}

    def size(self, token: str) -> int:
        return len(token) - len(self.end) * bool(self.end and token != self.end and token.endswith(self.end))

    @functools.cached_property
    def lookahead(self) -> int | None:
        """The longest chain of merges, each of a higher rank than the one before, in which the right side of the next
        begins with the left side of the last: the sum of the left sides' lengths. None: a token is an operand before
        it is made."""
        made = {a + b: i for (a, b), i in self.ranks.items()}  # the last merge that makes it
        chain: dict[str, int] = {}  # beginning of a right side -> the longest chain from a merge of such a right side on
        longest = 0
        for (a, b), i in sorted(self.ranks.items(), key=lambda x: -x[1]):
            if made.get(a, -1) >= i or made.get(b, -1) >= i:
                return None
            here = self.size(a) + chain.get(a, 0)
            longest = max(longest, here)
            for n in range(1, self.size(b) + 1):
                if chain.get(b[:n], 0) < here:
                    chain[b[:n]] = here
            chain[b] = max(here, chain.get(b, 0))
        return longest

    def merged(self, symbols: list[str]) -> list[str]:
        """Lowest rank first, leftmost of equals first."""
        return self._short(symbols) if len(symbols) <= 48 else self._long(symbols)

    def _short(self, symbols: list[str]) -> list[str]:
        get, none, s = self.ranks.get, 1 << 60, list(symbols)
        r = [get(p, none) for p in zip(s, s[1:])]
        while r and (k := min(r)) < none:
            i = r.index(k)
            s[i] = t = s[i] + s.pop(i + 1)
            del r[i]
            if i < len(r):
                r[i] = get((t, s[i + 1]), none)
            if i:
                r[i - 1] = get((s[i - 1], t), none)
        return s

    def _long(self, symbols: list[str]) -> list[str]:
        """The same by a heap of pairs over a linked list."""
        get, s, n = self.ranks.get, list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(k, i, s[i], s[i + 1]) for i in range(n - 1) if (k := get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j] = a + b, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (k := get((s[x], s[y]))) is not None:
                    heapq.heappush(heap, (k, x, s[x], s[y]))
        return [t for t in s if t is not None]


class WordStream:
    """Symbols of one word in, stable tokens out."""

    def __init__(self, merges: Merges, chunk: int = 256):
        self.m, self.held = merges, []
        self.window = None if merges.lookahead is None else merges.lookahead + chunk

    def feed(self, symbols: list[str]) -> list[str]:
        """symbols: the next ones of the word, as many as come at a time."""
        self.held += symbols
        return [] if self.window is None or len(self.held) < self.window else self._settled()

    def _settled(self) -> list[str]:
        stable, out, at = len(self.held) - self.m.lookahead, [], 0
        for token in self.m.merged(self.held):
            if at + self.m.size(token) > stable:
                break
            out.append(token)
            at += self.m.size(token)
        del self.held[:at]
        return out

    def close(self) -> list[str]:
        out, self.held = self.m.merged(self.held), []
        return out


class Words(dict):
    """word -> ids, worked out when first asked for; None for a word that is too long to be kept."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[int, ...] | None:
        return next(self.bpe.word(word), ()) if len(word) <= 64 and len(word.encode()) <= 64 else None


class WordBpe:
    """The tokenizer of a vocabulary file: NFC, white space as one space, lower case, split, bytes, merges with word ends."""

    def __init__(self, spec: dict, cache: int = 400_000):
        model = spec["model"]
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        self.end = model.get("end_of_word_suffix") or ""
        self.m = Merges(model["vocab"], pairs, self.end)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.joiner = " " if spec.get("decoder") is None else ""
        pattern = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self.split = regex.compile(pattern.replace(r"\s", SPACE))
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.blanks = [c for c in map(chr, range(0x3001)) if c != " " and self.spaces.fullmatch(c)]
        self.digits = {i: str(i) for i in self.names}
        self.most, self.seen = cache, Words(self)

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        for c in self.blanks:
            if c in text:
                text = text.replace(c, " ")
        if "  " in text:
            text = self.spaces.sub(" ", text)
        return text.replace("Σ", "σ").lower()  # each character alone: no final sigma

    def words(self, text: str, held: int = 1024) -> Iterator[list[str]]:
        """The words of a normal text, `held` at a time."""
        if len(text) <= 1 << 18 and not self.split.groups:
            words = self.split.findall(text)
            yield from (words[at : at + held] for at in range(0, len(words), held))
        else:
            found = self.split.finditer(text)
            while words := [m.group() for m in itertools.islice(found, held)]:
                yield words

    def word(self, word: str, piece: int = 1024) -> Iterator[tuple[int, ...]]:
        """Runs of ids of a word as they are settled; kept for short words met again."""
        table, get, raw, stream = byte_symbols(), self.m.vocab.get, word.encode(), WordStream(self.m)
        short, out = len(raw) <= 64, ()
        for at in range(0, len(raw), piece):
            symbols = list(map(table.__getitem__, raw[at : at + piece]))
            if last := at + piece >= len(raw):
                symbols[-1] += self.end
            tokens = stream.feed(symbols) + (stream.close() if last else [])
            out = tuple(map(get, tokens))
            if None in out:
                out = tuple(i for i in out if i is not None)
            if not short:
                yield out
        if short:
            if len(self.seen) >= self.most:
                self.seen.clear()
            self.seen[word] = out
            yield out

    def stream(self, text: str) -> Iterator[Iterable[int]]:
        """The encoding, some short words or a run of a long one at a time."""
        for part in self.marks.split(text) if self.marks and "<" in text else (text,):
            if part in self.special:
                yield (self.special[part],)
            elif part:
                for words in self.words(self.normal(part)):
                    ids = list(map(self.seen.__getitem__, words))
                    if None not in ids:
                        yield itertools.chain.from_iterable(ids)
                    else:
                        for w, known in zip(words, ids):
                            yield from self.word(w) if known is None else (known,)

    def runs(self, text: str, held: int = 4096) -> Iterator[list[int]]:
        """The ids, about `held` at a time."""
        now: list[int] = []
        for ids in self.stream(text):
            now += ids
            while len(now) >= held:
                yield now[:held]
                del now[:held]
        if now:
            yield now

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.stream(text) for i in ids]

    def digest(self, text: str, kept: list[int] | None = None) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids and of the text decoded from them. kept: gets the ids."""
        n, ids, decoded, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(self)
        for run in self.runs(text):
            ids.update(((" " if n else "") + " ".join(map(self.digits.__getitem__, run))).encode())
            decoded.update(decoder.feed_all(run).encode())
            n += len(run)
            if kept is not None:
                kept += run
        decoded.update(decoder.close().encode())
        return n, ids.hexdigest(), decoded.hexdigest()


class Decoder:
    """Ids in, text out as soon as its bytes are whole. A vocabulary without a decoder shows its tokens, a space between."""

    def __init__(self, bpe: WordBpe, as_text: bool = False):
        self.bpe, self.as_text, self.first = bpe, as_text, True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.bytes = {s: b for b, s in enumerate(byte_symbols())}

    def feed_all(self, ids: list[int]) -> str:
        """What a run of ids adds; unknown ids add nothing."""
        names = self.bpe.names
        try:
            tokens = list(map(names.__getitem__, ids))
        except KeyError:
            tokens = [names[i] for i in ids if i in names]
        if self.as_text:
            return "".join(map(self._text, tokens))
        if not tokens:
            return ""
        before, self.first = "" if self.first else self.bpe.joiner, False
        return before + self.bpe.joiner.join(tokens)

    def feed(self, i: int) -> str:
        return self.feed_all([i])

    def _text(self, token: str) -> str:
        if token in self.bpe.special:
            return self.utf8.decode(b"", True) + token
        end = bool(self.bpe.end) and token.endswith(self.bpe.end)
        raw = token[: -len(self.bpe.end)] if end else token
        return self.utf8.decode(bytes(self.bytes[c] for c in raw)) + (self.utf8.decode(b"", True) + " " if end else "")

    def close(self) -> str:
        return self.utf8.decode(b"", True) if self.as_text else ""


@functools.cache
def _made(spec: str) -> WordBpe:
    return WordBpe(json.loads(spec))


def encode_decode(docs, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and with keep_ids the ids), a row for each row of docs.

    vocabulary: the file's path on the driver; its content (under 2 MB) is broadcast.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    from .common import small_batches, whole_text

    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches):
        bpe = _made(spec.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            kept = [[] for _ in texts] if keep_ids else [None] * len(texts)
            cols = [bpe.digest(t, k) for t, k in zip(texts, kept)]
            arrays = [b.column(0), pa.array([c[0] for c in cols], pa.int64()), pa.array([c[1] for c in cols], pa.string()), pa.array([c[2] for c in cols], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, schema)
