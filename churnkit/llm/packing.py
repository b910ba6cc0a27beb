"""Packing of tokenized documents into training sequences: bounded-space online best fit, then merged leftovers.

Each partition reads its documents once. A fixed number of windows is open; a document goes whole into the open
window that it fills most tightly. When none has room for it, the fullest window is topped up with the
document's first tokens and emitted, so it holds no padding, and the rest of the document looks for a place
again. A document longer than a window gives full windows first. At the end a partition merges its own open windows
into full ones and one leftover; leftovers of neighbouring partitions are merged in rounds, FAN_IN at a time, until one
is left. That last one is cut into sequences whose lengths are powers of two, which need no padding either.

No text and no token is shuffled but the leftovers (less than one window per partition). Windows open per
task hold WINDOWS * length tokens at most. What a partition packs is written to the shared folder once, so
a lost executor cannot give some of its pieces twice.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.tables import sorted_groups, stage_table

#: open windows per partition
WINDOWS = 64
#: leftovers merged by one task
FAN_IN = 16
#: words and pieces of words whose ids a task remembers (of each; twice as many with the generation before)
MEMO_SIZE = 450_000
#: bytes of text whose distinct words are looked up together
CHUNK = 8_000_000
#: words longer than this are not remembered
LONG_WORD = 64

SCHEMA = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, part long"


class Memo(dict):
    """Results of `work` (a list of keys to their values), two generations; the older one is forgotten at MEMO_SIZE entries."""

    def __init__(self, work: Callable[[list], list]):
        self.work, self.before = work, {}

    def of(self, keys: list) -> list:
        """The values of distinct keys."""
        found = list(map(self.get, keys))
        missed = [i for i, v in enumerate(found) if v is None]
        if not missed:
            return found
        if len(self) >= MEMO_SIZE:
            self.before = dict(self)
            self.clear()
        old = self.before
        new = []
        for i in missed:
            k = keys[i]
            v = found[i] = old.get(k)
            if v is None:
                new.append(i)
            else:
                self[k] = v
        wanted = [keys[i] for i in new]
        for i, k, v in zip(new, wanted, self.work(wanted), strict=True):
            found[i] = v
            if len(k) <= LONG_WORD:
                self[k] = v
        return found


class WordTokenizer:
    """Ids of whole texts by a tokenizer that drops white space, so that words can be encoded one by one.

    A word is looked up as it stands. If it is missed and the tokenizer's file says that it only normalizes (NFC),
    lowers and cuts by one pattern, a word of Latin letters, digits and signs is cut by that pattern and its
    pieces are looked up, else encoded by the tokenizer's model; any other word is encoded by the tokenizer as a whole.
    """

    def __init__(self, path: str, special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.model = self.tokenizer.model
        self.by_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words, self.pieces = Memo(self.word_ids), Memo(self.piece_ids)
        self.plain = re.compile("[\x21-\x7e\xa1-\u024f]+").fullmatch   # normalized already, and no white space
        self.cut = None if special else piece_pattern(json.loads(self.tokenizer.to_str()))

    def word_ids(self, raw: list[bytes]) -> list[bytes]:
        words = b" ".join(raw).decode("utf-8").split(" ") if raw else []
        cut = self.cut
        split = [cut(w.lower()) if cut and self.plain(w) else None for w in words]
        names = list(set().union(*filter(None, split)))
        ids = dict(zip(names, self.pieces.of(names)))
        return [self.whole_ids(w) if s is None else b"".join([ids[p] for p in s]) for w, s in zip(words, split)]

    def whole_ids(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def piece_ids(self, pieces: list[str]) -> list[bytes]:
        out = []
        tokenize, by_bytes = self.model.tokenize, self.by_bytes.pre_tokenize_str
        for p in pieces:
            ids = [token.id for token in tokenize(p if p.isascii() else by_bytes(p)[0][0])]
            out.append(pack(f"<{len(ids)}I", *ids))
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of an Arrow string column; each distinct word of the column is looked up once."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))      # at the bytes 20 and 09-0D
        words = split.flatten().dictionary_encode()
        known = self.words.of(words.dictionary.cast(pa.binary()).to_pylist())
        ids = pa.array(known, type=pa.large_binary()).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset:ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, dtype=np.int64)
        cuts = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        raw = memoryview(ids.buffers()[2]) if cuts[-1] else b""
        return [bytes(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def piece_pattern(parts: dict) -> Callable[[str], list[str]] | None:
    """Cuts a lower-case word of the code points below 250 like the tokenizer of this description, if it is of the known kind.

    The letters and digits of its pattern are written out over those code points.
    """
    steps = (parts.get("normalizer") or {}).get("normalizers", [])
    cuts = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
    known = ([x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"}
             and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and (cuts[0]["behavior"], cuts[0]["invert"]) == ("Removed", True)
             and (cuts[1]["add_prefix_space"], cuts[1]["use_regex"]) == (False, False))
    pattern = cuts[0]["pattern"].get("Regex", "") if known else ""
    if not pattern or "\\p" in re.sub(r"\[[^]]*\]", "", pattern):
        return None
    for kind in "LN":
        of_kind = "".join(c for c in map(chr, range(0x21, 0x250)) if unicodedata.category(c)[0] == kind)
        pattern = pattern.replace(f"\\p{{{kind}}}", of_kind)
    return None if "\\p" in pattern else re.compile(pattern).findall


_TOKENIZERS: dict[tuple, WordTokenizer] = {}


class Packer:
    """Open windows of a partition. A piece is (document number, start, ids as bytes, document's tokens)."""

    def __init__(self, length: int, windows: int, first: int):
        self.size, self.windows = 4 * length, windows
        self.open: list[tuple[int, int]] = []           # (free bytes, window), ascending
        self.held: dict[int, list[tuple]] = {}
        self.next_window = 0
        self.next_id = first
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, tokens in pieces:
            self.out.append((doc, start, ids, tokens, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, doc, start: int, ids: bytes, tokens: int) -> None:
        """Place the ids (from `start` of their document on), full windows first."""
        at = 0
        while len(ids) - at >= self.size:
            self.emit([(doc, start + at // 4, ids[at:at + self.size], tokens)])
            at += self.size
        while at < len(ids):
            need = len(ids) - at
            k = bisect_left(self.open, (need, -1))
            if k < len(self.open):                      # the tightest window with room for all of it
                free, w = self.open.pop(k)
            elif len(self.open) < self.windows:
                free, w = self.size, self.next_window
                self.next_window += 1
                self.held[w] = []
            else:                                       # none has room: top up the fullest one
                free, w = self.open.pop(0)
                need = free
            self.held[w].append((doc, start + at // 4, ids[at:at + need], tokens))
            at += need
            if free == need:
                self.emit(self.held.pop(w))
            else:
                insort(self.open, (free - need, w))

    def merge(self) -> list[tuple]:
        """Empty the open windows, fullest first, into full ones; returns the pieces of the one leftover."""
        rest, free = [], self.size
        for _, w in self.open:
            for doc, start, ids, tokens in self.held.pop(w):
                at = 0
                while at < len(ids):
                    need = min(free, len(ids) - at)
                    rest.append((doc, start + at // 4, ids[at:at + need], tokens))
                    at += need
                    free -= need
                    if not free:
                        self.emit(rest)
                        rest, free = [], self.size
        self.open = []
        return rest

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def powers_of_two(pieces: list[tuple]) -> list[list[tuple]]:
    """Pieces dealt, in order, to sequences whose lengths are falling powers of two."""
    left = sum(len(p[2]) // 4 for p in pieces)
    free, out = 0, []
    for doc, start, ids, tokens in pieces:
        at = 0
        while at < len(ids):
            if not free:
                free = 4 << (left.bit_length() - 1)
                out.append([])
            need = min(free, len(ids) - at)
            out[-1].append((doc, start + at // 4, ids[at:at + need], tokens))
            at += need
            free -= need
            left -= need // 4
    return out


def text_chunks(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Index ranges of a string column of about `size` bytes each, or one text more."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    a = 0
    while a < len(texts):
        b = 1 + int(np.searchsorted(total, (total[a - 1] if a else 0) + size))
        yield a, min(b, len(texts))
        a = b


def _batch(rows: list[tuple], id_type: pa.DataType, part) -> pa.RecordBatch:
    """Rows of (doc, start, ids, tokens, sequence, offset); `part` marks leftovers, null else."""
    doc, start, ids, tokens, sequence, offset = zip(*rows) if rows else ([],) * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, type=id_type), pa.array(start, type=pa.int64()), pa.array([len(x) // 4 for x in ids], type=pa.int64()), pa.array(ids, type=pa.binary()),
         pa.array(tokens, type=pa.int64()), pa.array(sequence, type=pa.int64()), pa.array(offset, type=pa.int64()), pa.array([part] * len(ids), type=pa.int64())],
        names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "part"])


def _first_id(level: int, part: int) -> int:
    """Sequence numbers: 7 bits for the round, 32 for the partition, 24 for its sequences."""
    return (level << 56) + (part << 24)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096, windows: int = WINDOWS, special: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) that pack all documents into sequences.

    A document is its ids by the tokenizer file, then `end_id`; `start` counts its ids before the piece, `ids` is
    binary (little-endian unsigned 32-bit), `doc_tokens` counts its ids with the end. Every id lies in one piece. A
    sequence holds `length` ids, but for the last ones of the whole table, whose lengths are different powers of two.
    The tokenizer must not join what white space separates (it drops it). Strings of special tokens are ordinary
    text unless `special` is true.

    A null or empty text is its end id alone. Rows without doc_id and rows that share one are packed as documents of
    their own. An empty table gives no pieces. Other columns of `docs` are not read. Which sequence a piece falls
    into depends on the partitions of `docs`; the number of sequences does not.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType
    schema = SCHEMA.format(id=kind.simpleString())
    end = pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        key = (tokenizer, special)
        if key not in _TOKENIZERS:
            _TOKENIZERS[key] = WordTokenizer(*key)
        encode, packer, id_type = _TOKENIZERS[key].encode, Packer(length, windows, _first_id(0, part)), None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            id_type = ids.type
            ids = ids.to_pylist()
            for a, b in text_chunks(texts, CHUNK):
                for doc, found in zip(ids[a:b], encode(texts.slice(a, b - a))):
                    packer.add(doc, 0, found + end, len(found) // 4 + 1)
                yield _batch(packer.taken(), id_type, None)
        if id_type is not None:
            rest = packer.merge()
            yield _batch(packer.taken(), id_type, None)
            packer.emit(rest)
            yield _batch(packer.taken(), id_type, part)

    packed = [stage_table(rows.mapInArrow(run, schema), "packed")]
    level = 1
    while True:
        left = packed[-1].filter("part is not null")
        most = left.agg(F.max("part")).first()[0]
        packed[-1] = packed[-1].filter("part is null")
        if most is None:
            break
        packed.append(stage_table(_merged(left, schema, length, windows, level, last=most < FAN_IN), "leftovers"))
        level += 1
    out = packed[0]
    for more in packed[1:]:
        out = out.unionByName(more)
    return out.drop("part")


def _merged(left: DataFrame, schema: str, length: int, windows: int, level: int, last: bool) -> DataFrame:
    """One round: the leftovers of FAN_IN neighbouring partitions become full sequences and one leftover (none in the last)."""
    groups = left.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
    groups = groups.repartition("part").sortWithinPartitions("part", "sequence_id", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["part"]):
            part, id_type = group.column("part")[0].as_py(), group.schema.field("doc_id").type
            packer = Packer(length, windows, _first_id(level, part))
            for row in zip(*(group.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
                packer.add(*row)
            rest = packer.merge()
            for pieces in powers_of_two(rest) if last else []:
                packer.emit(pieces)
            yield _batch(packer.taken(), id_type, None)
            if rest and not last:
                packer.emit(rest)
                yield _batch(packer.taken(), id_type, part)

    return groups.mapInArrow(run, schema)
