"""BPE encoding and decoding with content-defined chunk reuse.

A text's UTF-8 bytes are cut where a rolling hash of the last 16 bytes hits a mask, so
a passage that many documents share is cut into the same chunks wherever it stands.
Every distinct chunk is encoded once in a task and kept in a bounded table, across
documents and batches; an idle worker holds no table.

A cut may fall inside a word, so the tokens beside a join are not to be trusted.  Every
join is repaired: the text from the last whole word before it to the first whole word
after it is encoded anew, and must begin and end with exactly the ids that the two chunks
have for these words.  What stands between them replaces the join; where an end does not
agree, the document goes to the general repair.

The general repair serves every tokenizer, also those that keep white space or merge
across it.  Chunks are encoded whole, as pre-tokens with their places.  A window around a
join is encoded anew and grows, to the left until it starts with three pre-tokens that the
text before it has at the same places, to the right until it meets three of the chunk
there; a window that reaches the text's ends needs no agreement.  It at least doubles when
it takes in further chunks, so a text without any boundary costs its length twice.

Tokenizers that drop white space (probed when one is loaded) have the whole words inside
of a chunk encoded in batches, each distinct word once.

The chunk table is a task's own: one for the whole cluster would move all text
through a shuffle twice to save what the word table saves already.

Defined cases: null and empty texts have no ids, and decode to the empty text; other
columns of the input are neither read nor returned; repeated rows are encoded each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of, trim, worker_table

WINDOW = 16
#: A cut every 256 bytes on average.
CUT_MASK = 0xFF
#: Bounds of a task's tables, in entries of a generation of words (there are two) and bytes of chunks.
MAX_WORDS = 90_000
MAX_CHUNK_BYTES = 10_000_000

#: Words that are encoded as one text.
JOINED = 48
#: Pre-tokens that must agree at an end of a window, and on either side of a join at first.
AGREE = 3
NEAR = 6
_ASCII_PARTS = re.compile(rb"[A-Za-z]+|[0-9]|[^A-Za-z0-9]+")

_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


#: A pre-token: its ids and its place in the text's characters.
Unit = tuple[tuple[int, ...], int, int]


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; the last is its length.  No cut splits a UTF-8 sequence."""
    n = len(data)
    if n <= WINDOW:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    step = 1
    while step < WINDOW:  # doubling: a window of 2 * step from two of step
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    # the top bits depend on the whole window
    hit = np.flatnonzero((h[WINDOW - 1 : -1] >> np.uint32(24) & CUT_MASK) == 0) + WINDOW
    hit = hit[(raw[hit] & 0xC0) != 0x80]
    return [*hit.tolist(), n]


class ChunkEncoder:
    """Encodes and decodes texts exactly as the tokenizers library does, with chunk reuse."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(size)]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ending = np.array([bool(suffix) and t is not None and t.endswith(suffix) for t in self.tokens])
        self.clear()
        self.chunk_hits = self.chunk_misses = self.disagreed = 0
        direct = lambda s: self.tokenizer.encode(s, add_special_tokens=False).ids
        #: White space is dropped and nothing merges across it, so words are encoded apart.
        self.by_words = all(direct(f"b,a{w}1c{v}́x") == [*direct("b,a"), *direct("1c"), *direct("́x")] for w in " \t\n\r\x0b\x0c" for v in (" ", "\n "))

    def clear(self) -> None:
        """Empty the tables."""
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # the generation before: words in use move on, others go
        self.chunks: dict[bytes, tuple] = {}
        self.joins: dict[bytes, bytes] = {}
        self.spans: dict[bytes, list[Unit]] = {}
        self.chunk_bytes = 0

    def _split(self, chunk: bytes) -> tuple[list[bytes], int, int] | None:
        """Whole words, where the last one starts and the first one ends; None if there is no whole word."""
        parts = chunk.split()
        head = len(parts[0]) if parts and not chunk[:1].isspace() else 0
        whole = parts[1:] if head else parts
        tail = len(whole[-1]) if whole and not chunk[-1:].isspace() else 0
        if tail:
            whole = whole[:-1]
        if not whole:
            return None
        last = len(chunk[: len(chunk) - tail].rstrip()) - len(whole[-1])
        return whole, last, len(chunk) - len(chunk[head:].lstrip()) + len(whole[0])

    def _learn(self, missing: list[bytes]) -> None:
        """Encode words that the table doesn't hold.

        Joined by line feeds, a few dozen at a time, which costs the library less; the
        ids are cut apart after the tokens that end a pre-token.  That needs the number
        of pre-tokens of every word: known for ASCII words without an apostrophe, and at
        least one for each word of letters, so that equal totals prove one each.
        """
        alone: list[bytes] = []
        groups: list[tuple[list[bytes], list[int]]] = [([], []), ([], [])]
        for w in missing:
            if w.isascii():
                if b"'" in w or b"<|" in w:
                    alone.append(w)
                else:
                    groups[0][0].append(w)
                    groups[0][1].append(len(_ASCII_PARTS.findall(w)))
            elif w.decode("utf-8", "replace").isalpha():
                groups[1][0].append(w)
                groups[1][1].append(1)
            else:
                alone.append(w)
        for members, counts in groups:
            starts = range(0, len(members), JOINED)
            joined = [b"\n".join(members[k : k + JOINED]).decode("utf-8", "replace") for k in starts]
            for k, e in zip(starts, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = np.flatnonzero(self.ending[ids]) + 1
                n = counts[k : k + JOINED]
                if len(ends) != sum(n) or (len(ids) and ends[-1] != len(ids)):
                    alone += members[k : k + JOINED]
                    continue
                raw, at = ids.tobytes(), 0
                for w, end in zip(members[k : k + JOINED], ends[np.cumsum(n) - 1].tolist(), strict=True):
                    self.words[w] = raw[4 * at : 4 * end]
                    at = end
        for w, e in zip(alone, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in alone], add_special_tokens=False), strict=True):
            self.words[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.chunk_bytes > MAX_CHUNK_BYTES:
            self.chunks, self.joins, self.spans = {}, {}, {}
            self.chunk_bytes = 0
        return self._encode_words(texts) if self.by_words else [self._repaired(t) for t in texts]

    def _encode_words(self, texts: list[str]) -> list[bytes]:
        """``encode`` for tokenizers that drop white space."""
        if len(self.words) > MAX_WORDS:
            self.words, self.older = {}, self.words
        chunks, words, older = self.chunks, self.words, self.older
        fresh: dict[bytes, tuple | None] = {}
        plans: list[list] = []  # of each text: join, chunk, join, ..., chunk, join
        wanted: set[bytes] = set()
        for text in texts:
            data = text.encode("utf-8", "surrogatepass")
            plan: list = []
            start = since = 0  # since: where the last whole word so far starts
            for end in cut_points(data):
                key = data[start:end]
                if key in chunks:
                    entry = chunks[key]
                    self.chunk_hits += 1
                elif key in fresh:
                    entry = fresh[key]
                    self.chunk_hits += 1
                else:
                    self.chunk_misses += 1
                    entry = fresh[key] = self._split(key)
                    if entry:
                        wanted.update(entry[0])
                if entry is not None:
                    plan += [data[since : start + entry[2]], key]
                    since = start + entry[1]
                start = end
            plan.append(data[since:])
            plans.append(plan)
        missing = []
        for w in wanted:
            if w not in words:
                if w in older:
                    words[w] = older[w]
                else:
                    missing.append(w)
        if missing:
            self._learn(missing)
        for key, entry in fresh.items():
            if entry is not None:
                found = [words[w] for w in entry[0]]
                # ids, those of the first and the last word, and the places of both
                entry = (b"".join(found), entry[1], entry[2], found[0], found[-1])
                self.chunk_bytes += len(entry[0]) + len(key)
            chunks[key] = entry
            self.chunk_bytes += len(key) + 250
        joins = self.joins
        unknown = list({x for plan in plans for x in plan[::2] if x not in joins})
        for x, e in zip(unknown, self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in unknown], add_special_tokens=False), strict=True):
            joins[x] = np.array(e.ids, "<u4").tobytes()
            self.chunk_bytes += len(x) + len(joins[x]) + 150
        out = []
        for text, plan in zip(texts, plans, strict=True):
            ids, left = [], b""
            for k in range(0, len(plan), 2):
                join = joins[plan[k]]
                entry = chunks[plan[k + 1]] if k + 1 < len(plan) else None
                right = entry[3] if entry else b""
                if len(join) < len(left) + len(right) or not (join.startswith(left) and join.endswith(right)):
                    self.disagreed += 1
                    ids = [self._repaired(text)]
                    break
                ids.append(join[len(left) : len(join) - len(right)])
                if entry:
                    ids.append(entry[0])
                    left = entry[4]
            out.append(b"".join(ids))
        return out

    def encode_flat(self, texts: list[str], most_words: int = MAX_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has; words are looked up once a call.

        For callers that need no chunks: tokenizers that drop white space encode each
        distinct word once, others the whole texts.
        """
        if not self.by_words:
            found = self.encode(texts)
            return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
        if len(self.words) > most_words:
            self.words, self.older = {}, self.words
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        spelled = pa.array([w for ws in split for w in ws], pa.binary()).dictionary_encode()
        distinct = spelled.dictionary.to_pylist()
        words, older, missing = self.words, self.older, []
        for w in distinct:
            if w not in words:
                if w in older:
                    words[w] = older[w]
                else:
                    missing.append(w)
        if missing:
            self._learn(missing)
        ids = [words[w] for w in distinct]
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        codes = spelled.indices.to_numpy(zero_copy_only=False)
        each = sizes[codes]
        shift = np.cumsum(sizes)[codes] - np.cumsum(each)  # from a place in the result to one among the distinct words' ids
        flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(shift, each) + np.arange(int(each.sum()))] if len(each) else np.zeros(0, "<u4")
        bounds = np.concatenate([[0], np.cumsum(each)])[np.cumsum([0, *(len(ws) for ws in split)])]
        return flat, np.diff(bounds)

    def _units(self, text: str, start: int = 0) -> list[Unit]:
        """The pre-tokens of a text that stands at ``start``: ids and place."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        out: list[Unit] = []
        before = None
        for i, word, (a, b) in zip(e.ids, e.word_ids, e.offsets, strict=True):
            if out and word is not None and word == before:
                ids, first, last = out[-1]
                out[-1] = ((*ids, i), first, max(last, start + b))
            else:
                out.append(((i,), start + a, start + b))
            before = word
        return out

    def _chunk_units(self, key: bytes, start: int) -> list[Unit]:
        if key in self.spans:
            self.chunk_hits += 1
        else:
            self.chunk_misses += 1
            self.spans[key] = self._units(key.decode("utf-8", "replace"))
            self.chunk_bytes += len(key) + 300 * len(self.spans[key])
        return [(ids, a + start, b + start) for ids, a, b in self.spans[key]]

    def _repaired(self, text: str) -> bytes:
        """The ids of a text by any tokenizer: chunks, and windows around joins that grow until both ends agree."""
        data = text.encode("utf-8", "surrogatepass")
        keys, ends, at = [], [], 0
        for end in cut_points(data):
            keys.append(data[at:end])
            ends.append((ends[-1] if ends else 0) + len(keys[-1].decode("utf-8", "replace")))
            at = end
        done = self._chunk_units(keys[0], 0) if keys else []
        c = 1
        while c < len(keys):
            back, ahead = NEAR, NEAR
            while True:
                i = max(0, len(done) - back)
                while i and done[i - 1][1] >= done[i - 1][2]:  # a pre-token without a place
                    i -= 1
                begin = done[i - 1][2] if i else 0
                right = self._chunk_units(keys[c], ends[c - 1])
                whole = ahead >= len(right)
                stop = ends[c] if whole else right[ahead - 1][2]
                window = self._units(text[begin:stop], begin)
                if i and window[:AGREE] != done[i : i + AGREE]:
                    back *= 2
                    continue
                if whole and c == len(keys) - 1:
                    done[i:] = window
                    break
                places = {u[1:]: j for j, u in enumerate(right) if u[1] < u[2]}
                met = ((k, places[u[1:]]) for k, u in enumerate(window[: 1 - AGREE]) if u[1:] in places)
                found = next(((k, j) for k, j in met if window[k : k + AGREE] == right[j : j + AGREE]), None)
                if found:
                    done[i:] = window[: found[0]] + right[found[1] :]
                    break
                if whole:
                    goal = begin + 2 * (stop - begin)
                    while c < len(keys) - 1 and ends[c] < goal:
                        c += 1
                    ahead = len(keys[c])
                else:
                    ahead *= 2
            c += 1
        return np.array([x for ids, _, _ in done for x in ids], "<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        """As ``decode(ids, skip_special_tokens=False)``: without a decoder, tokens joined by spaces."""
        found = np.frombuffer(ids, "<u4").tolist()
        if self.tokenizer.decoder is None:
            tokens = self.tokens
            return " ".join([tokens[i] for i in found])
        return self.tokenizer.decode(found, skip_special_tokens=False)


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    return worker_table(("bpe", path), lambda: ChunkEncoder(path))


def slices(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters, so that a batch of long texts stays small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """Encode and decode every text: id, ``ids`` (binary, little-endian uint32), ``n_tokens``, ``decoded``.

    A map over the rows: no shuffle, and a row's result depends on its text alone.
    """
    small_batches(docs.sparkSession)
    path = tokenizer_path or default_tokenizer_path()
    source = docs.select(F.col(id_col), text_of(text_col).alias("__text"))
    id_type = source.schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 1_000_000):
                ids = enc.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(ids, pa.binary()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([enc.decode(x) for x in ids], pa.string()),
                    ],
                    names=[id_col, "ids", "n_tokens", "decoded"],
                )
        enc.clear()
        trim()

    from pyspark.sql import types as T

    schema = T.StructType([id_type, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])
    return source.mapInArrow(run, schema)


def op1_bpe(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Query: digests of the ids and of the decoded text of every document."""
    from .common import table

    out = encode_documents(docs if docs is not None else table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
