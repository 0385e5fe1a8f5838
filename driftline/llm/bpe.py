"""Byte-level BPE over Arrow batches with the tokenizers library, and decoding through the byte table."""

from __future__ import annotations

import base64
import codecs
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Documents that a task holds as Python objects at once.
SLICE = 256
#: Remembered chunks of text: a task that has more begins anew, and looks once more at as many older ones.
REMEMBER = 300_000
#: Chunks that are encoded as one text: the library takes longer for each chunk of a long text.
TOGETHER = 128


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    table = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [table[b] for b in range(256)]


def from_ranks(path: str, pattern: str) -> str:
    """A tokenizers file, as a string, that encodes like the rank file at `path`, each match of `pattern` by itself.

    Ranks order merges of any two tokens whose bytes joined are a token, so each way to split a token in two becomes
    a merge of the token's rank; a match that is a token as a whole stays whole.
    """
    table = byte_characters()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    spell = lambda token: "".join(table[b] for b in token)
    merges = []
    for token in sorted(ranks, key=ranks.get):
        splits = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges += [[spell(a), spell(b)] for a, b in sorted(splits, key=lambda s: (ranks[s[0]], ranks[s[1]]))]
    steps = [
        {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
    ]
    model = {
        "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False,
        "ignore_merges": True, "vocab": {spell(t): r for t, r in ranks.items()}, "merges": merges,
    }
    return json.dumps({"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}, "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}, "model": model})


def from_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class Encoder:
    """Encodes texts chunk by chunk and remembers the ids of chunks.

    A space between two characters that are not white space always begins a new match of the GPT-2 pattern, whatever
    is around it, so a text can be cut there and equal chunks have equal ids.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.lengths = byte_table(spec).lengths
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> None:
        """Encodes chunks that a cut precedes many at once, as one text, and cuts the ids by the chunks' bytes."""
        for at in range(0, len(chunks), TOGETHER):
            part = chunks[at : at + TOGETHER]
            joined = " " + " ".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            sizes = np.fromiter(map(len, part), "i8", len(part)) if joined.isascii() else np.fromiter((len(c.encode()) for c in part), "i8", len(part))
            ends = 4 * (1 + np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes + 1)))
            raw, start = ids.tobytes(), 0
            for chunk, end in zip(part, ends.tolist(), strict=True):
                self.later[chunk] = raw[start:end]
                start = end

    def _learn_first(self, chunks: set[str]) -> None:
        new = [*chunks.difference(self.first)]
        for chunk, got in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.first[chunk] = np.array(got.ids, "<u4").tobytes()

    @staticmethod
    def _whole(chunk: str) -> bool:
        return bool(chunk) and not chunk[0].isspace() and not chunk[-1].isspace()

    def _joined(self, chunks: list[str]) -> list[str]:
        """Chunks put together again where a cut would touch other white space."""
        out = [chunks[0]]
        for chunk in chunks[1:]:
            if chunk and out[-1] and not chunk[0].isspace() and not out[-1][-1].isspace():
                out.append(chunk)
            else:
                out[-1] += " " + chunk
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.later) > REMEMBER:
            self.later, self.older = {}, self.later
        if len(self.first) > REMEMBER:
            self.first.clear()
        cut = [t.split(" ") for t in texts]
        ids, odd = self._known(cut)
        if odd:
            cut = [chunks if odd.isdisjoint(chunks) else self._joined(chunks) for chunks in cut]
            ids, _ = self._known([chunks[1:] for chunks in cut])
        self._learn_first({chunks[0] for chunks in cut})
        # without odd ones a text's first chunk is learned for later places too: that is cheaper than to look where else it is
        new = [c for c, found in ids.items() if found is None]
        self._learn(new)
        ids.update((c, self.later[c]) for c in new)
        return [self.first[c[0]] + b"".join(map(ids.__getitem__, c[1:])) for c in cut]

    def _known(self, cut: list[list[str]]) -> tuple[dict[str, bytes | None], set[str]]:
        """What is remembered of each chunk, or None; of those without, the ones that a cut touches other white space at."""
        seen = set(chain.from_iterable(cut))
        ids = dict(zip(seen, map(self.later.get, seen), strict=True))
        for c in [c for c, found in ids.items() if found is None]:
            if (found := self.older.get(c)) is not None:
                ids[c] = self.later[c] = found
        return ids, {c for c, found in ids.items() if found is None and not self._whole(c)}


_ENCODERS: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """This process's encoder for a tokenizers file."""
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def forget() -> None:
    """Lets go of this process's encoder: tasks of other operators, in a worker that is used again, need its memory."""
    _ENCODERS.clear()


class ByteTable:
    """The bytes of each id, by the vocabulary's byte characters."""

    def __init__(self, spec: str):
        of = {c: b for b, c in enumerate(byte_characters())}
        loaded = json.loads(spec)
        special = {t["content"]: t["id"] for t in loaded["added_tokens"]}
        vocab = loaded["model"]["vocab"]
        self.bytes = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in special else bytes(of[c] for c in token)
        for token, i in special.items():
            self.bytes[i] = token.encode()
        self.lengths = np.array([len(b) for b in self.bytes], "i8")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def pieces(self, ids: list[int]) -> list[str]:
        """The text that each id completes: a character split over ids comes with its last one."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        out = [reader.decode(self.bytes[i]) for i in ids]
        if out:
            out[-1] += reader.decode(b"", final=True)
        return out

    def offsets(self, ids: np.ndarray, text: bytes) -> np.ndarray:
        """First character and end of each token: those of every character that one of its bytes belongs to."""
        ends = np.cumsum(self.lengths[ids])
        character = np.cumsum((np.frombuffer(text, "u1") & 0xC0) != 0x80)
        first = character[ends - self.lengths[ids]] - 1 if len(ids) else ends
        return np.stack([first, character[ends - 1] if len(ids) else ends], 1)


_TABLES: dict[int, ByteTable] = {}


def byte_table(spec: str) -> ByteTable:
    key = hash(spec)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = ByteTable(spec)
    return _TABLES[key]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, "i4")]).astype("i4")))


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    """Slices of a text column, nulls as empty texts, with the place of each slice."""
    for at in range(0, batch.num_rows, SLICE):
        yield at, [t or "" for t in batch.column(column).slice(at, SLICE).to_pylist()]


def encode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """Encodes every whole text: id, `ids` array<int>, and with `offsets` their first characters and ends.

    `spec` is a tokenizers file with a byte-level vocabulary; no special tokens are added. Null and empty texts give no
    ids. Rows are taken one by one: repeated rows and ids give equal rows, other columns are not read, and an empty
    table gives an empty result. Tasks hold a slice of documents and a bounded memory of chunks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    kind = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if offsets:
        fields += [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("starts", "ends")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = encoder(shared.value), byte_table(shared.value) if offsets else None
        for batch in batches:
            for at, texts in texts_of(batch, "_text"):
                ids = [np.frombuffer(x, "<u4") for x in own.encode(texts)]
                columns = [batch.column("_id").slice(at, len(texts)), _lists(ids)]
                if table:
                    spans = [table.offsets(i, t.encode()) for i, t in zip(ids, texts, strict=True)]
                    columns += [_lists([s[:, k] for s in spans]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).mapInArrow(run, T.StructType(fields))


def decode(rows: DataFrame, spec: str, ids_col: str = "ids") -> DataFrame:
    """Adds `decoded`, the bytes of each row's ids, in place of a column of that name. Null ids count as none.

    Bytes, since ids cut anywhere may begin or end inside a character; `ByteTable.pieces` gives the text by token.
    """
    shared = rows.sparkSession.sparkContext.broadcast(spec)
    rows = rows.drop("decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = pa.array([table.decode(i or []) for i in part.column(ids_col).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=schema.names)

    return rows.mapInArrow(run, schema)
