"""SentencePiece encoding and decoding by a max-plus parallel scan over chunks of the texts.

The ids are those of the model file (BPE with byte fallback). A text's encoding is found as a best path over its chunks:

1. Two neighbouring pieces may follow each other exactly if encoding their joined text gives these two again. A text's
   encoding is the only sequence of pieces whose neighbours all may: with weight 0 for these and minus infinity for all
   others it is the path of the greatest sum, and paths through chunks compose by max-plus matrix products.
2. A boundary's state is the piece over its last character, as (characters before, characters after the boundary). No
   piece of the model goes on after a word's end, so where a word begins there is only one state. A chunk's transfer
   matrix is then the product of that of its first word's rest, of those of its whole words (one state to one state)
   and of that of its last word's start; words' ids and cut words' matrices are held by worker. A chunk inside one
   word has a matrix of its own over all its characters.
3. Per document the matrices are combined from the front and from the back (max-plus products are associative); the
   one state of each boundary that lies on a path of weight 0 both ways is the encoding's.
4. With both its states known, each chunk traces its own pieces back, independently of the others.

Every document goes this way. Chunks of a document of more than ``SPREAD`` chunks are rows of their own, dealt over the
tasks, and only its (sparse) matrices come together; those of a shorter one stay in the task that read it. A document
with a chunk that no single path of weight 0 crosses goes to the library whole, with 1 for its chunks. Decoding
concatenates the pieces' bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, small_batches, text_or_empty
from .tokens import as_bytes, vocabulary_path

CHUNK = 4_096
#: Chunks of a document above which they are dealt over the tasks.
SPREAD = 16
SPACE = "▁"
#: Pairs of pieces, and cut words, whose results a worker holds; some hundred bytes each.
PAIRS = 50_000
#: Words whose ids a worker holds.
WORDS = 300_000
WORD_START = re.compile(f"(?<=[^{SPACE}]){SPACE}")
WHOLE_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")

State = tuple[int, int]
#: The state before the first character.
START: State = (0, 0)


class Pieces:
    """A model's pieces, and which may follow which."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        n = self.library.vocab_size()
        plain = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_byte(i) or self.library.is_unknown(i))]
        self.ids = {self.library.id_to_piece(i): i for i in plain}
        self.scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.bytes_of = [b""] * n
        for p, i in self.ids.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        if odd := [p for p in self.ids if WORD_START.search(p)]:
            raise ValueError(f"texts cannot be cut before words with the pieces {odd[:5]}")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.own: dict[str, bool] = {}
        self.words: dict[str, bytes] = {}  # without their first space sign
        self.cut: dict[tuple, list] = {}

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: again and again the pair whose piece scores best is joined, the leftmost of equals."""
        parts = list(text)
        while True:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def is_piece(self, text: str) -> bool:
        """Whether a text is one symbol of some encoding; a character that the model lacks is."""
        if len(text) == 1 or text not in self.ids:
            return len(text) == 1
        if text not in self.own:
            self.own[text] = self.merged(text) == [text]
        return self.own[text]

    def may_follow(self, a: str, b: str) -> bool:
        if (a, b) not in self.pairs:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = self.merged(a + b) == [a, b]
        return self.pairs[a, b]

    def learn(self, words: set[str]) -> None:
        """Takes in the ids of whole words; the library puts the first space sign before each."""
        if len(self.words) + len(words) > WORDS:
            self.words.clear()
        self.words[""] = as_bytes(self.ids_of(SPACE))  # of an empty text the library makes nothing
        new = list(words - {""})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.words.update(zip(part, map(as_bytes, self.library.encode([w.replace(SPACE, " ") for w in part], num_threads=1)), strict=True))

    def once(self, key: tuple, find) -> list:
        """What find() gives, held under the key."""
        if key not in self.cut:
            if len(self.cut) >= PAIRS:
                self.cut.clear()
            self.cut[key] = find()
        return self.cut[key]

    def ids_of(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.byte_ids[b] for b in piece.encode()]


@cache
def model(path: str) -> Pieces:
    return Pieces(path)


def _entries(pieces: Pieces, text: str, at: int) -> list[State]:
    """The states that the boundary before text[at] can have."""
    if at == 0:
        return [START]
    most = pieces.longest
    return [
        (i, j)
        for i in range(1, min(most, at) + 1)
        for j in range(min(most - i, len(text) - at) + 1)
        if pieces.is_piece(text[at - i : at + j])
    ]


def _ways(pieces: Pieces, text: str, start: int, end: int, entries: list[State]) -> dict[int, dict[int, tuple[int, int | None]]]:
    """By end and start of a piece: which entries (as bits) have a path of weight 0 to it, and the start of the piece before.

    Pieces are those over characters from start to end - 1, and the entries' own.
    """
    at: dict[int, dict[int, tuple[int, int | None]]] = {}
    for k, (i, j) in enumerate(entries):
        held = at.setdefault(start + j, {})
        held[start - i] = held.get(start - i, (0, None))[0] | 1 << k, None
    for b in range(start, end):
        before = at.get(b)
        if not before:
            continue
        for c in range(b + 1, min(b + pieces.longest, len(text)) + 1):
            piece = text[b:c]
            if not pieces.is_piece(piece):
                continue
            for a, (bits, _) in before.items():
                if a == b or pieces.may_follow(text[a:b], piece):  # a == b: nothing is before the first piece
                    held = at.setdefault(c, {})
                    old = held.get(b, (0, a))
                    held[b] = old[0] | bits, a if old[0] == 0 else old[1]
    return at


def transfer(pieces: Pieces, text: str, start: int, end: int) -> list[tuple[State, State]]:
    """The pairs of states at start and end with weight 0, for a chunk text[start:end] with what stands around it."""
    entries = _entries(pieces, text, start)
    found = []
    for c, held in _ways(pieces, text, start, end, entries).items():
        for b, (bits, _) in held.items():
            if c >= end > b:
                found += [(entry, (end - b, c - end)) for k, entry in enumerate(entries) if bits >> k & 1]
    return found


def backtrace(pieces: Pieces, text: str, start: int, end: int, entry: State, leave: State) -> list[str]:
    """The pieces after the entry's up to and with the last state's."""
    at = _ways(pieces, text, start, end, [entry])
    b, c, last, found = end - leave[0], end + leave[1], start + entry[1], []
    while c > last:
        found.append(text[b:c])
        b, c = at[c][b][1], b
    return found[::-1]


def whole_words(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The first and the last place in text[start:end] (end included) where a word begins or the text ends."""
    begins = lambda at: at in (0, len(text)) or (text[at] == SPACE and text[at - 1] != SPACE)
    first = start
    if not begins(start):
        found = WORD_START.search(text, start + 1, min(end + 1, len(text)))
        first = found.start() if found else end
    if not begins(first):
        return None
    last = end
    while not begins(last):
        last = text.rfind(SPACE, first, last)
    return first, last


def _head(pieces: Pieces, text: str, start: int, first: int) -> tuple[tuple, str, int, int]:
    """The key, and the characters on which pieces from start on depend, to the next word's begin."""
    low = max(start - pieces.longest, 0)
    return ("head", text[low:first], start - low), text[low:first], start - low, first - low


def _tail(pieces: Pieces, text: str, last: int, end: int) -> tuple[tuple, str, int]:
    own = text[last : end + pieces.longest]
    return ("tail", own, end - last), own, end - last


def matrix(pieces: Pieces, text: str, start: int, end: int) -> list[tuple[State, State]]:
    """As transfer(), with START for the one state of a boundary where a word begins or the text ends."""
    words = whole_words(text, start, end)
    if words is None:
        return transfer(pieces, text, start, end)
    first, last = words
    heads, tails = [START], [START]
    if first > start:
        key, own, at, to = _head(pieces, text, start, first)

        def entering() -> list[State]:
            entries = _entries(pieces, own, at)
            bits = 0
            for found, _ in _ways(pieces, own, at, to, entries).get(to, {}).values():
                bits |= found
            return [entry for k, entry in enumerate(entries) if bits >> k & 1]

        heads = pieces.once(key, entering)
    if last < end:
        key, own, to = _tail(pieces, text, last, end)
        tails = pieces.once(key, lambda: [x for _, x in transfer(pieces, own, 0, to)])
    return [(x, y) for x in heads for y in tails]


def trace(pieces: Pieces, text: str, start: int, end: int, entry: State, leave: State) -> list[bytes | str]:
    """The ids of the pieces after the entry's up to and with the last state's, as bytes; whole words as text."""
    words = whole_words(text, start, end)
    as_ids = lambda found: as_bytes([i for p in found for i in pieces.ids_of(p)])
    if words is None:
        return [as_ids(backtrace(pieces, text, start, end, entry, leave))]
    first, last = words
    made: list[bytes | str] = []
    if first > start:
        key, own, at, to = _head(pieces, text, start, first)

        def entered() -> bytes:
            if at + entry[1] == to:
                return b""
            (b,) = _ways(pieces, own, at, to, [entry])[to]
            return as_ids(backtrace(pieces, own, at, to, entry, (to - b, 0)))

        made.append(pieces.once((*key, entry), entered))
    if first < last:
        made.append(text[first:last])
    if last < end:
        key, own, to = _tail(pieces, text, last, end)
        made.append(pieces.once((*key, leave), lambda: as_ids(backtrace(pieces, own, 0, to, START, leave))))
    return made


def words_of(text: str) -> list[str]:
    """The words of a text that begins with one, without their first space signs."""
    if SPACE * 2 in text:
        return [w[1:] for w in WHOLE_WORD.findall(text)]
    return text[1:].split(SPACE)


def states(matrices: list[list[tuple[State, State]]]) -> list[State] | None:
    """The state at each boundary, from the first to the last, on the path of weight 0 through all chunks, if it is one."""
    front = [{START}]
    for m in matrices:
        front.append({x for e, x in m if e in front[-1]})
    back = [{s for s in front[-1] if s[1] == 0}]
    for m in reversed(matrices):
        back.append({e for e, x in m if x in back[-1]})
    both = [f & b for f, b in zip(front, reversed(back), strict=True)]
    return [x.pop() for x in both] if all(len(x) == 1 for x in both) else None


def joined(pieces: Pieces, found: list[list[bytes | str]]) -> list[bytes]:
    """The ids of each list of traced parts; words that the worker has not met yet are encoded first."""
    parts = [[x if isinstance(x, bytes) else words_of(x) for x in row] for row in found]
    known = pieces.words
    new = {w for row in parts for x in row if not isinstance(x, bytes) for w in x if w not in known}
    if new:
        if len(known) + len(new) > WORDS:  # the words at hand stay
            new = {w for row in parts for x in row if not isinstance(x, bytes) for w in x}
        pieces.learn(new)
    return [b"".join([x if isinstance(x, bytes) else b"".join([known[w] for w in x]) for x in row]) for row in parts]


def scan(pieces: Pieces, texts: list[str], chunk: int = CHUNK) -> list[tuple[int, bytes]]:
    """Number of chunks and ids of each text."""
    counts, found = [], []
    for text in map(_normalized, texts):
        bounds = [(k, min(k + chunk, len(text))) for k in range(0, len(text), chunk)]
        at = states([matrix(pieces, text, a, b) for a, b in bounds]) if len(bounds) > 1 else [START] * 2
        counts.append(len(bounds) if at else 1)
        if at is None:
            found.append([as_bytes(pieces.library.encode(text[1:].replace(SPACE, " "), num_threads=1))])
        else:
            found.append([x for (a, b), entry, leave in zip(bounds, at, at[1:]) for x in trace(pieces, text, a, b, entry, leave)])
    return list(zip(counts, joined(pieces, found), strict=True))


def _normalized(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


CHUNKS = "digest binary, k int, chunks int, text string, start int, end int"


def _chunked(path: str, chunk: int):
    """Chunks with the characters around them that their pieces can reach."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = model(path).longest
        for batch in batches:
            for digest, text in zip(batch["digest"], batch["text"], strict=True):
                text = _normalized(text.as_py())
                n = -(-len(text) // chunk)
                for k in range(n):
                    low, high = max(k * chunk - around, 0), min((k + 1) * chunk + around, len(text))
                    row = {"digest": digest.as_py(), "k": k, "chunks": n, "text": text[low:high], "start": k * chunk - low, "end": min((k + 1) * chunk, len(text)) - low}
                    yield pa.RecordBatch.from_pylist([row], pa.schema([("digest", pa.binary()), ("k", pa.int32()), ("chunks", pa.int32()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    return made


_MATRIX = pa.schema([("digest", pa.binary()), ("k", pa.int32()), ("pairs", pa.list_(pa.int16()))])


def _matrices(path: str):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            for r in batch.to_pylist():
                pairs = [x for e, s in matrix(pieces, r["text"], r["start"], r["end"]) for x in (*e, *s)]
                yield pa.RecordBatch.from_pylist([{"digest": r["digest"], "k": r["k"], "pairs": pairs}], _MATRIX)

    return made


def _scanned(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("k")
    quads = [np.asarray(p, int).reshape(-1, 4).tolist() for p in rows["pairs"]]
    found = states([[((a, b), (c, d)) for a, b, c, d in q] for q in quads])
    edges = [(*a, *b) for a, b in zip(found[:-1], found[1:], strict=True)] if found else [None] * len(rows)
    return rows[["digest", "k"]].assign(edges=edges)


def _traced(path: str):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            rows = batch.to_pylist()
            parts = [trace(pieces, r["text"], r["start"], r["end"], tuple(r["edges"][:2]), tuple(r["edges"][2:])) for r in rows]
            for r, ids in zip(rows, joined(pieces, parts), strict=True):
                r["ids"] = ids
            columns = [pa.array([r[c] for r in rows], t) for c, t in (("digest", pa.binary()), ("k", pa.int32()), ("chunks", pa.int32()), ("ids", pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "k", "chunks", "ids"])

    return made


def _small(path: str, chunk: int):
    """Encodes texts inside the task, some megabytes at a time."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                chunks, ids = zip(*scan(pieces, part["text"].to_pylist(), chunk))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(chunks, pa.int32()), pa.array([[x] for x in ids], pa.list_(pa.binary()))], ["doc_id", "chunks", "parts"])

    return made


def _joined_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [b"".join(x.as_py()) for x in batch["parts"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["chunks"], pa.array(ids, pa.binary())], ["doc_id", "chunks", "ids"])


ENCODED = "doc_id long, chunks int, ids binary"
#: Chunks that one task takes; each costs some milliseconds.
CHUNKS_A_TASK = 32


def encode(docs: DataFrame, path: str | None = None, spread: int = SPREAD, chunk: int = CHUNK) -> DataFrame:
    """doc_id, chunks (by which the document was encoded) and ids (little-endian unsigned 32-bit) of each row of docs.

    A null or empty text has no chunks and no ids. Rows that repeat have equal results; a null doc_id is passed on; an
    empty table gives an empty table; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    path = path or vocabulary_path("piece_bpe_32k.model")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    large = F.char_length("text") >= spread * chunk  # one character, the first space sign, comes to it
    parted = "doc_id long, chunks int, parts array<binary>"
    small = rows.where(~large).mapInArrow(_small(path, chunk), parted)
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    giants = rows.where(large).select("doc_id", digest, "text")
    texts = giants.groupBy("digest").agg(F.first("text").alias("text"))  # equal texts are encoded once
    chunks = cut_lineage(texts.mapInArrow(_chunked(path, chunk), CHUNKS), "chunks")
    n = chunks.count()
    if not n:
        return small.mapInArrow(_joined_parts, ENCODED)
    tasks = -(-n // CHUNKS_A_TASK)
    dealt = chunks.repartition(tasks, "digest", "k")
    matrices = dealt.select("digest", "k", "text", "start", "end").mapInArrow(_matrices(path), "digest binary, k int, pairs array<short>")
    edges = cut_lineage(matrices.groupBy("digest").applyInPandas(_scanned, "digest binary, k int, edges array<int>"), "edges")
    found = chunks.join(edges.where("edges is not null"), ["digest", "k"]).repartition(tasks, "digest", "k")
    traced = found.mapInArrow(_traced(path), "digest binary, k int, chunks int, ids binary")
    parts = F.array_sort(F.collect_list(F.struct("k", "ids")))
    whole = traced.groupBy("digest").agg(F.first("chunks").alias("chunks"), F.transform(parts, lambda x: x["ids"]).alias("parts"))
    made = small.unionByName(giants.select("doc_id", "digest").join(whole, "digest").select("doc_id", "chunks", "parts"))
    missed = edges.where("edges is null").select("digest").distinct()
    if not missed.isEmpty():
        made = made.unionByName(giants.join(missed, "digest", "left_semi").select("doc_id", "text").mapInArrow(_small(path, 1 << 40), parted))
    return made.mapInArrow(_joined_parts, ENCODED)


def decoded(pieces: Pieces, ids: np.ndarray) -> str:
    """The text behind ids; the space before the first piece is the model's own."""
    return b"".join([pieces.bytes_of[i] for i in ids.tolist()])[1:].decode("utf-8", "replace")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text."""
    path = path or vocabulary_path("piece_bpe_32k.model")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            texts = [decoded(pieces, np.frombuffer(x.as_py() or b"", "<u4")) for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(made, "doc_id long, text string")


def digest(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32, n_chunks, and bytes and crc32 of the decoded text, of encode()'s rows."""
    path = path or vocabulary_path("piece_bpe_32k.model")
    names = ["doc_id", "n_ids", "ids_crc32", "n_chunks", "decoded_bytes", "decoded_crc32"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            rows = []
            for x in batch["ids"]:
                ids = x.as_py()
                text = decoded(pieces, np.frombuffer(ids, "<u4")).encode()
                rows.append((len(ids) // 4, zlib.crc32(ids), len(text), zlib.crc32(text)))
            n, crc, size, text_crc = (pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], n, crc, batch["chunks"], size, text_crc], names)

    return encoded.select("doc_id", "chunks", "ids").mapInArrow(made, "doc_id long, n_ids long, ids_crc32 long, n_chunks int, decoded_bytes long, decoded_crc32 long")
