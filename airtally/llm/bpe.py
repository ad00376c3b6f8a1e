"""BPE encoding and decoding, with tree concatenation for long texts.

The tokenizers library does the encoding. Two things are added around it:

*Words.* A tokenizer whose pre-tokenizer drops white space never joins what ASCII white space
separates, so a text's ids are its words' ids one after the other. Each worker remembers the ids
of the words it has met. Other tokenizers get whole texts.

*Tokens of words.* Most new words consist of letters, digits and marks that were met in other words.
Of tokenizers that lower-case and split like CLIP's, printable ASCII words are split by the same
pattern for a whole slice at once, and only parts not met before go to the library's model.

*Tree concatenation.* A text above ``piece_chars`` characters is cut into halves, and these again,
wherever the cut falls. Pieces are encoded in parallel as rows of their own. Neighbours are then
joined level by level: a window around the cut is encoded again and grows until it has one token
in common with the left side and one with the right side (same id, same characters). Up to and
from these tokens the sides are kept. That is exact: a sequence of BPE tokens is the encoding of
its text if each two neighbours are that of theirs, and every two neighbours in the joined sequence
are neighbours in the left side, in the window or in the right side. A window that reaches both
ends is the encoding itself.

Ids travel as one binary value for each text, packed little-endian unsigned 32-bit integers.

Defined cases: a null text is an empty text and has no ids; a null id column is kept; repeated
rows come out as often as they go in; an empty table gives an empty table; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import Recall, owned, release

PIECE_CHARS = 65_536
#: Bytes of text that are handled at a time in a task, besides a longer single text. A word is looked up
#: once for each slice.
SLICE_BYTES = 8_000_000
#: Words that are encoded as one text.
TOGETHER = 2_000
FIRST_WINDOW = 64
#: How CLIP's tokenizers normalise and split, and the same pattern for lower-case printable ASCII.
CLIP = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
ASCII_PART, PRINTABLE = r"('s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+)", "^[!-~]+$"


class Encoder:
    """The library's tokenizer, with the words of a worker remembered."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        # only these two parts are described; the whole tokenizer as JSON takes much more memory
        parts = {name: getattr(self.tokenizer, name) for name in ("normalizer", "pre_tokenizer")}
        described = {name: json.loads(part.__getstate__()) for name, part in parts.items() if part is not None}
        self.by_word = drops_white_space(described)
        self.model = self.tokenizer.model
        self.by_part = described == CLIP and type(self.model).__name__ == "BPE" and not self.model.dropout and not any(t.normalized for t in added)
        self.known = Recall()

    def encode(self, texts: pa.StringArray) -> pa.BinaryArray:
        """Packed ids of each text."""
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return pa.array([packed(e.ids) for e in found], pa.binary())
        # only ASCII white space is sure to separate; a leading one leaves an empty word
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        first, sizes, table = self.table_of(words.dictionary)
        ends, ids = laid_out(first, sizes, table, words.indices.to_numpy())
        bounds = split.offsets.to_numpy().astype(np.int64)
        offsets = ends[bounds - bounds[0]] * 4
        if offsets[-1] > np.iinfo(np.int32).max:
            raise ValueError("texts of one slice have more than 2 GB of ids")
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])

    def table_of(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different words: where those of each begin in a table, how many they are, and the table."""
        first, sizes = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        plain = np.zeros(len(words), dtype=bool)
        if self.by_part:
            plain = pc.match_substring_regex(words, PRINTABLE).to_numpy(zero_copy_only=False)
            for s in self.special:
                plain &= ~pc.match_substring(words, s).to_numpy(zero_copy_only=False)
        other = table_from(self.ids_of(words.filter(pa.array(~plain)).to_pylist()))
        first[~plain], sizes[~plain], table = other
        if plain.any():
            apart = pc.replace_substring_regex(pc.ascii_lower(words.filter(pa.array(plain))), ASCII_PART, r"\1 ")
            split = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(apart))
            parts = split.flatten().dictionary_encode()
            known = table_from(self.known.values(parts.dictionary.to_pylist(), self.part_ids))
            ends, ids = laid_out(*known, parts.indices.to_numpy())
            bounds = split.offsets.to_numpy().astype(np.int64)
            bounds = ends[bounds - bounds[0]]
            first[plain], sizes[plain] = bounds[:-1] + len(table), np.diff(bounds)
            table = np.concatenate([table, ids])
        return first, sizes, table

    def part_ids(self, parts: list[str]) -> list[bytes]:
        """Packed ids of parts that the pattern cut; their bytes stand for themselves."""
        return [packed([t.id for t in self.model.tokenize(part)]) for part in parts]

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Packed ids of different words."""
        return self.known.values(words, self.new_ids)

    def new_ids(self, words: list[str]) -> list[bytes]:
        out = []
        for start in range(0, len(words), TOGETHER):
            part = words[start : start + TOGETHER]
            # one text of many words costs less than as many texts; their places tell them apart
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begin = np.fromiter(map(itemgetter(0), found.offsets), dtype=np.int64, count=len(found.ids))
            length = np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1
            cuts = np.searchsorted(begin, np.cumsum(length)).tolist()
            ids, last = np.array(found.ids, dtype="<u4").tobytes(), 0
            for cut in cuts:
                out.append(ids[last * 4 : cut * 4])
                last = cut
        return out

    def tokens(self, text: str) -> Tokens:
        """Ids of one text with the characters each stands for."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        spans = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
        return Tokens(text, np.array(found.ids, dtype="<u4"), spans[:, 0], spans[:, 1])

    def decode(self, ids: bytes) -> str:
        return self.tokenizer.decode(np.frombuffer(ids, dtype="<u4").tolist(), skip_special_tokens=False)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    held = owned("tokenizers")
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def drops_white_space(described: dict) -> bool:
    """Whether the tokenizer splits at white space first and keeps none of it."""
    if "Prepend" in json.dumps(described.get("normalizer")):
        return False
    step = described.get("pre_tokenizer") or {}
    if step.get("type") == "Sequence":
        step = (step["pretokenizers"] or [{}])[0]
    if step.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
        return True
    if step.get("type") != "Split" or step.get("behavior") != "Removed" or not step.get("invert"):
        return False
    # the pattern lists what is kept: classes without white space, and literals
    import regex

    return not any(regex.search(step["pattern"].get("Regex", r"\s"), c) for c in " \t\n\r\v\f")


def table_from(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed ids one after the other: where each begins, how many it has, and all of them."""
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    return np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(ids), dtype="<u4")


def laid_out(first: np.ndarray, sizes: np.ndarray, table: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a table one after the other: their bounds and what they hold."""
    n = sizes[which]
    ends = np.concatenate([[0], np.cumsum(n)])
    small = max(int(ends[-1]), len(table)) <= np.iinfo(np.int32).max
    taken = np.repeat((first[which] - ends[:-1]).astype(np.int32 if small else np.int64), n)
    taken += np.arange(len(taken), dtype=taken.dtype)
    return ends, table[taken]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@dataclass
class Tokens:
    """The encoding of a text by itself."""

    text: str
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def whole(self) -> np.ndarray:
        """Tokens that begin and end between characters; some stand for a part of one."""
        before = np.concatenate([[0], np.maximum.accumulate(self.ends)[:-1]]) if len(self.ids) else self.ends
        after = np.concatenate([self.starts[1:], [len(self.text)]]) if len(self.ids) else self.ends
        return (self.starts >= before) & (self.ends <= after) & (self.starts < self.ends)


def cut_points(text: str, piece_chars: int, special: list[str]) -> list[int]:
    """Where to cut: halves, until no part is above ``piece_chars``."""
    cuts: list[int] = []
    parts = [(0, len(text))]
    while parts:
        start, end = parts.pop()
        if end - start <= piece_chars:
            continue
        at = safe_cut(text, (start + end) // 2, start, end, special)
        if at is not None:
            cuts.append(at)
            parts += [(start, at), (at, end)]
    return sorted(cuts)


def safe_cut(text: str, middle: int, start: int, end: int, special: list[str]) -> int | None:
    """The place nearest to the middle that divides neither a special token nor a composed
    character; None if there is none."""
    longest = max([1, *map(len, special)])
    for step in range(end - start):
        for at in {middle - step, middle + step}:
            if not start < at < end or unicodedata.combining(text[at]):
                continue
            pair = text[at - 1 : at + 1]
            if not pair.isascii() and unicodedata.normalize("NFC", pair) != "".join(unicodedata.normalize("NFC", c) for c in pair):
                continue
            near, own = text[max(0, at - longest) : at + longest], at - max(0, at - longest)
            if any(0 <= near.find(s, max(0, own - len(s) + 1), own + len(s) - 1) < own for s in special):
                continue
            return at
    return None


def join(encoder: Encoder, left: Tokens, right: Tokens) -> Tokens:
    """The encoding of two neighbours as one text."""
    text, cut = left.text + right.text, len(left.text)
    left_whole, right_whole = left.whole(), right.whole()
    width = FIRST_WINDOW
    while True:
        # the window begins and ends where a token does
        begins = np.flatnonzero(left_whole & (left.starts >= cut - width))
        finishes = np.flatnonzero(right_whole & (right.ends <= width))
        all_left, all_right = width >= cut or not len(begins), width >= len(right.text) or not len(finishes)
        low = 0 if all_left else int(left.starts[begins[0]])
        high = len(text) if all_right else cut + int(right.ends[finishes[-1]])
        window = encoder.tokens(text[low:high])
        if all_left and all_right:
            return window
        starts, ends, whole = window.starts + low, window.ends + low, window.whole()
        in_left = {(int(left.ids[i]), int(left.starts[i]), int(left.ends[i])): i for i in begins} if not all_left else {}
        in_right = {(int(right.ids[i]), cut + int(right.starts[i]), cut + int(right.ends[i])): i for i in finishes} if not all_right else {}
        keys = list(zip(window.ids.tolist(), starts.tolist(), ends.tolist(), strict=True))
        a = next(((in_left[k], j) for j, k in enumerate(keys) if whole[j] and k in in_left), None)
        b = next(((in_right[k], j) for j, k in enumerate(keys) if whole[j] and k in in_right), None)
        if (all_left or a) and (all_right or b):
            i, j = a or (-1, -1)
            n, m = b or (len(right.ids), len(keys))
            parts = [(left.ids, left.starts, left.ends, slice(0, i + 1), 0), (window.ids, starts, ends, slice(j + 1, m), 0), (right.ids, right.starts, right.ends, slice(n, None), cut)]
            return Tokens(
                text,
                np.concatenate([ids[s] for ids, _, _, s, _ in parts]),
                np.concatenate([begin[s] + shift for _, begin, _, s, shift in parts]),
                np.concatenate([end[s] + shift for _, _, end, s, shift in parts]),
            )
        width *= 2


def join_all(encoder: Encoder, pieces: list[Tokens]) -> Tokens:
    """Join neighbours, then the results, up to the whole text."""
    while len(pieces) > 1:
        pieces = [join(encoder, *pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


def slices(values: pa.StringArray | pa.BinaryArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of values that hold about ``most`` bytes each, or a single longer one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, end
        start = end


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = PIECE_CHARS, decoded: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` (packed) of every text; ``tokenizer`` is a path that executors can read.

    Texts above ``piece_chars`` are shuffled as pieces, all others are encoded where they are read.
    With ``decoded``, the task that has a text's ids also decodes them, as :func:`decode` does.
    """
    schema = "doc_id long, ids binary" + ", decoded string" * decoded
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = F.length("text") > piece_chars

    def short_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            for start, end in slices(batch.column("text")):
                columns = [batch.column("doc_id").slice(start, end - start), own.encode(batch.column("text").slice(start, end - start))]
                if decoded:
                    columns.append(pa.array([own.decode(x.as_py()) for x in columns[1]], pa.string()))
                yield pa.record_batch(columns, ["doc_id", "ids", "decoded"][: len(columns)])
                del columns
                release()
            del batch  # the next one is read before the name is bound again

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = encoder(tokenizer).special
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                bounds = [0, *cut_points(text, piece_chars, special), len(text)]
                pieces = [text[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                # columns stay as they are: a null among large ids must not turn them to doubles
                same = [batch.column(c).take(pa.array([i] * len(pieces))) for c in ("doc_id", "times", "digest")]
                yield pa.record_batch([*same, pa.array(range(len(pieces)), pa.int32()), pa.array(pieces)], ["doc_id", "times", "digest", "piece", "text"])

    def piece_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            for start in range(0, batch.num_rows, 16):
                part = batch.slice(start, 16)
                found = [own.tokens(text) for text in part.column("text").to_pylist()]
                packed_ = [[t.ids.tobytes() for t in found], [t.starts.astype("<i8").tobytes() for t in found], [t.ends.astype("<i8").tobytes() for t in found]]
                yield pa.record_batch([*part.columns, *(pa.array(x, pa.binary()) for x in packed_)], [*part.schema.names, "ids", "starts", "ends"])

    def joined(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("piece")
        parts = zip(*(rows[c].to_pylist() for c in ("text", "ids", "starts", "ends")), strict=True)
        pieces = [Tokens(text, np.frombuffer(ids, "<u4"), np.frombuffer(starts, "<i8"), np.frombuffer(ends, "<i8")) for text, ids, starts, ends in parts]
        own = encoder(tokenizer)
        ids = join_all(own, pieces).ids.astype("<u4").tobytes()
        out = rows.slice(0, 1).select(["doc_id", "times"]).append_column("ids", pa.array([ids], pa.binary()))
        return out.append_column("decoded", pa.array([own.decode(ids)])) if decoded else out

    short = rows.where(~long).mapInArrow(short_ids, schema)
    # rows that are alike are cut and joined once
    whole = rows.where(long).withColumn("digest", F.sha2("text", 256)).groupBy("doc_id", "digest").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    fields = "doc_id long, times long, digest string, piece int, text string"
    pieces = (
        whole.mapInArrow(cut, fields)
        .repartition("doc_id", "digest", "piece")
        .mapInArrow(piece_ids, f"{fields}, ids binary, starts binary, ends binary")
    )
    found = pieces.groupBy("doc_id", "digest").applyInArrow(joined, "doc_id long, times long, ids binary" + ", decoded string" * decoded)
    found = found.withColumn("nth", F.explode(F.expr("sequence(1, times)"))).drop("times", "nth")
    return short.unionByName(found)


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``, the library's text for the packed ids, special tokens included; null for null."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            for start, end in slices(batch.column(ids_col)):
                part = batch.slice(start, end - start)
                decoded = pa.array([None if x is None else own.decode(x) for x in part.column(ids_col).to_pylist()], pa.string())
                yield pa.record_batch([*part.columns, decoded], [*part.schema.names, "decoded"])

    encoded = encoded.drop("decoded")
    schema = f"{encoded._jdf.schema().toDDL()}, decoded string"
    return encoded.mapInArrow(texts, schema)


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Sizes and digests of ids and of the decoded text of every document."""
    return encode(docs, tokenizer, decoded=True, **options).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
