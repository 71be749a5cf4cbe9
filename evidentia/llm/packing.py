"""Packing into fixed windows by the sum-of-squares rule.

Each partition packs its own documents, without a shuffle. A level array counts the partially filled windows at each fill. A document of s tokens goes to the
fill h (or a new window) for which the sum of the squared counts after the step is least. Of a document longer than
a window, full windows are cut first and only the rest is placed.

The open windows are bounded. Where they have room for OPEN tokens (LARGE, for documents of more than half a window) no new one is begun; a document that fits into none of them is cut: it completes the window at a fill h and what is left is
placed at the fill r = h + s - window, as a window of its own. The rule chooses here too: the growth of the sum of squares is that of one window leaving h and one
coming to r. So a worker holds at most OPEN tokens in windows and the documents in them, whatever the partition.

At the end of a partition no window may be begun any more: the emptiest open window is taken apart and its pieces are placed by the same rule, until one is
left, which is cut into windows of powers of two, which need no padding. So all windows of all partitions are free of padding, and every shared window comes from the rule.

Defined cases: a null or empty text has only its end token. A null id is carried as null. Repeated rows are packed as
often as they occur. An empty table gives no rows. Other columns are left aside. Reruns over the same input
partitions give the same rows; a sequence's number is its partition's number * 2^32 plus a running number.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict, deque
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ._shared import table

TOKENIZER, END, WINDOW = public_tokenizers.path("byte_bpe_50k.json"), 1, 2048
#: Tokens that partially filled windows of a partition have room for, and those from which on a document of more than half a window, which pairs with none of its kind, begins none.
OPEN, LARGE = 384 * 2048, 96 * 2048
SCHEMA = "doc_id {}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
PROBE = " It's naïve—1,234 words\n\n\tthe  end… été ñandú 漢字 \U0001f642 don't!! <|endoftext|>x"


def printable_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes are themselves, the others follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


@lru_cache
def encoder(path: str, special: bool = True):
    """A function from a text to the token ids, as uint32, that tokenizers gives for the file with add_special_tokens=False.

    Without `special` the strings of special tokens inside a text are plain text. A byte-level BPE whose ids follow the order of its merges has the same ids under tiktoken, which reads its
    vocabulary from the same file here and is three times as fast. This is checked on the file (form, order of merges)
    and on a probe text; any other file is left to tokenizers.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = not special

    def slow(text: str) -> np.ndarray:
        return np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)

    spec = json.load(open(path, encoding="utf-8"))
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
        return slow
    import tiktoken

    byte = printable_bytes()
    named = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
    vocab = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in named}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    made = [model["vocab"][m] for m in merges]
    if made != sorted(made) or any(t["content"] not in named for t in spec.get("added_tokens", [])):
        return slow
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens=named)
    allowed = {"allowed_special": "all"} if special else {"disallowed_special": ()}

    def quick(text: str) -> np.ndarray:
        return fast.encode_to_numpy(text, **allowed)

    return quick if np.array_equal(quick(PROBE), slow(PROBE)) else slow


class Packer:
    """Windows of one partition. Pieces are (document, start, tokens); emit(pieces of a window) is called for each closed window."""

    def __init__(self, window: int, emit):
        self.window, self.emit = window, emit
        self.most, self.most_large = OPEN // window, LARGE // window
        self.count = np.zeros(window + 1, np.int64)  # open windows by fill
        self.open: dict[int, deque] = defaultdict(deque)
        self.n_open = 0

    def add(self, doc: int, ids: np.ndarray) -> None:
        w, at = self.window, 0
        while len(ids) - at >= w:
            self.emit([(doc, at, ids[at : at + w])])
            at += w
        if at < len(ids):
            self._place((doc, at, ids[at:]))

    def _take(self, fill: int) -> list:
        self.count[fill] -= 1
        self.n_open -= 1
        return self.open[fill].popleft()

    def _begin(self, fill: int, pieces: list) -> None:
        self.open[fill].append(pieces)
        self.count[fill] += 1
        self.n_open += 1

    def _place(self, piece: tuple) -> None:
        count, w = self.count, self.window
        doc, start, ids = piece
        s = len(ids)
        # Growth of the sum of squares when a window goes from fill h to h + s.
        gain = np.full(w, np.iinfo(np.int64).max)
        gain[: w + 1 - s] = 2 * (count[s : w + 1] - count[: w + 1 - s]) + 2
        gain[w - s] = 1 - 2 * count[w - s]  # the window is full and leaves
        gain[count[:w] == 0] = np.iinfo(np.int64).max
        if self.n_open < (self.most if 2 * s <= w else self.most_large):
            gain[0] = 2 * count[s] + 1  # a new window
        elif not count[1 : w + 1 - s].any():  # h too full: its window leaves, and the rest begins one
            gain[w - s + 1 :] = np.where(count[w - s + 1 : w] > 0, 2 * (count[1:s] - count[w - s + 1 : w]) + 2, gain[w - s + 1 :])
        h = int(gain.argmin())
        held = self._take(h) if h else []
        room = w - h
        held.append((doc, start, ids[:room]))
        if s < room:
            self._begin(h + s, held)
            return
        self.emit(held)
        if s > room:
            self._begin(s - room, [(doc, start + room, ids[room:])])

    def close(self) -> None:
        while self.n_open > 1:
            pieces = self._take(min(fill for fill, own in self.open.items() if own))
            self.most = self.most_large = 0
            for piece in pieces:
                self._place(piece)
        pieces = next((own[0] for own in self.open.values() if own), [])
        left = sum(len(ids) for _, _, ids in pieces)
        while left:
            window, room, rest = [], (size := 1 << (left.bit_length() - 1)), []
            for k, (doc, start, ids) in enumerate(pieces):
                window.append((doc, start, ids[:room]))
                used = min(room, len(ids))
                room -= used
                if not room:
                    rest = ([(doc, start + used, ids[used:])] if used < len(ids) else []) + pieces[k + 1 :]
                    break
            self.emit(window)
            pieces, left = rest, left - size
        self.open.clear()
        self.count[:] = 0
        self.n_open = 0


def _pack(tokenizer: str, window: int, end: int):
    def run(batches):
        encode = encoder(tokenizer)
        here = TaskContext.get()
        number = (here.partitionId() if here else 0) << 32
        rows: list[tuple] = []
        docs: dict[int, list] = {}  # id, tokens, tokens not yet in a closed window

        def emit(pieces: list[tuple]) -> None:
            nonlocal number
            offset = 0
            for doc, start, ids in pieces:
                about = docs[doc]
                rows.append((about[0], start, len(ids), zlib.crc32(ids.astype("<u4", copy=False)), about[1], number, offset))
                offset += len(ids)
                about[2] -= len(ids)
                if not about[2]:
                    del docs[doc]
            number += 1

        def flush(schema: pa.Schema) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return out

        packer, n, schema = Packer(window, emit), 0, None
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            schema = schema or pa.schema([("doc_id", ids.type), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
            for k in range(len(texts)):
                tokens = encode(texts[k].as_py() or "")
                tokens = np.append(tokens, np.uint32(end))
                docs[n] = [ids[k].as_py(), len(tokens), len(tokens)]
                packer.add(n, tokens)
                n += 1
                if len(rows) >= 20_000:
                    yield flush(schema)
        packer.close()
        if rows:
            yield flush(schema)

    return run


def pack(docs: DataFrame, *, tokenizer: str = TOKENIZER, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. tokenizer is a path that each executor has."""
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(_pack(tokenizer, window, end), SCHEMA.format(docs.schema["doc_id"].dataType.simpleString()))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
