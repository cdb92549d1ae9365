"""Best-fit packing of documents into training sequences: bounded-space online best fit, open bins in a bitset by free space.

Texts are encoded and cut into pieces, pieces are dealt to tasks by the hash of a row number, whatever their ids, and each
task packs its share as a stream. A window of pieces is looked at before its pieces are placed, longest first."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from .common import durable, own_names

CAPACITY, OPEN_BINS, WINDOW, PER_TASK = 2048, 4096, 4096, 1 << 16
LETTERS = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]+"  # Latin ones whose lower case is one letter
PLAIN = re.compile(LETTERS)


def default_tokenizer() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


class Encoder:
    """Ids of texts as little-endian 32-bit integers, `add_special_tokens` off, of a tokenizer that drops white space and
    ends a word's last piece with a mark: a text's ids are then those of its words between spaces, one after another.

    A batch's different words are found in Arrow; those of letters are lower-cased and freed of a stop or comma behind them.
    What is left is looked up in a memo, begun anew when `most` words are held, or encoded: words of letters many to a
    call, all others one by one."""

    def __init__(self, spec: str, most: int = 1_500_000, longest: int = 64) -> None:
        from tokenizers import Tokenizer

        self.tok, self.most, self.longest = Tokenizer.from_str(spec), most, longest
        mark = self.tok.model.end_of_word_suffix
        self.ends = np.zeros(self.tok.get_vocab_size() + 1, dtype=bool)
        for piece, i in self.tok.get_vocab().items():
            self.ends[i] = bool(mark) and piece.endswith(mark)
        self.by_word = bool(mark) and '"Lowercase"' in spec and not len(self.whole([" \n"])[0])
        self.memo: dict[str, bytes] = {}
        if self.by_word:
            self.stop, self.comma = (pa.scalar(x.tobytes(), pa.large_binary()) for x in self.whole([".", ","]))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        plain = [w for w in words if PLAIN.fullmatch(w)]
        for group in (plain[i : i + 512] for i in range(0, len(plain), 512)):
            ids = self.whole([" ".join(group)])[0]
            cuts, raw = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), ids.tobytes()
            if len(cuts) == len(group):
                own = [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
            else:  # a word that the tokenizer takes apart
                own = [x.tobytes() for x in self.whole(group)]
            self.memo.update(zip(group, own, strict=True))
        odd = [w for w in words if not PLAIN.fullmatch(w)]
        self.memo.update(zip(odd, (x.tobytes() for x in self.whole(odd)), strict=True))

    def known(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        fresh = [w for w in words if w not in self.memo]
        if len(self.memo) + len(fresh) > self.most:
            self.memo, fresh = {}, words
        long = [w for w in fresh if len(w) > self.longest]  # not held
        self.learn([w for w in fresh if len(w) <= self.longest] if long else fresh)
        if not long:
            return [self.memo[w] for w in words]
        own = dict(zip(long, (x.tobytes() for x in self.whole(long)), strict=True))
        return [self.memo[w] if w in self.memo else own[w] for w in words]

    def encode(self, texts: pa.Array) -> list[bytes]:
        if not self.by_word or not len(texts):
            return [x.tobytes() for x in self.whole(texts.to_pylist())]
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        each = words.dictionary
        plain = pc.match_substring_regex(each, f"^{LETTERS}[.,]?$")
        cores = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(each, ".,")), each).dictionary_encode()
        ids = pa.array(self.known(cores.dictionary.to_pylist()), pa.large_binary()).take(cores.indices)
        none = pa.scalar(b"", pa.large_binary())
        behind = lambda c, own: pc.if_else(pc.and_(plain, pc.ends_with(each, c)), own, none)
        ids = pc.binary_join_element_wise(ids, behind(".", self.stop), behind(",", self.comma), none).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[: len(ids) + 1]
        cuts = ends[np.cumsum([0, *pc.list_value_length(split).to_pylist()])].tolist()
        data = ids.buffers()[2]
        return [data[a:b].to_pybytes() for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=2)
def encoder(spec: str) -> Encoder:
    return Encoder(spec)


@own_names
def pieces(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, end: int = 0, keep_ids: bool = True, rows: int = 2048) -> DataFrame:
    """Each document's ids, then `end`, cut into pieces of `capacity` where there are more: in place of text piece int (from
    0), start (ids before it), length, ids_crc32 of the ids as little-endian 32-bit integers, and ids (such bytes) if asked.

    Null texts count as empty, which have the one id `end`; every document has a piece. Repeated rows are cut alike; an empty
    table gives an empty one; columns with the added names are replaced. tokenizer: the content of a tokenizers file. Whole
    texts are encoded, `rows` at a time."""
    spec = default_tokenizer() if tokenizer is None else tokenizer
    added = ["piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    docs = docs.drop(*(c for c in [*added, "ids"] if c != text))
    names = [c for c in docs.columns if c != text]
    last, width = int(end).to_bytes(4, "little"), 4 * capacity

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec)
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                texts = part.column(part.schema.get_field_index(text)).fill_null("")
                whole = [x + last for x in enc.encode(texts)]
                cut = [(i, k, x[k : k + width]) for i, x in enumerate(whole) for k in range(0, len(x), width)]
                take = pa.array([i for i, _, _ in cut], pa.int32())
                own = [
                    pa.array([k // width for _, k, _ in cut], pa.int32()), pa.array([k // 4 for _, k, _ in cut], pa.int64()),
                    pa.array([len(x) // 4 for _, _, x in cut], pa.int64()), pa.array([zlib.crc32(x) for _, _, x in cut], pa.int64()),
                    *([pa.array([x for _, _, x in cut], pa.binary())] if keep_ids else []),
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)).take(take) for n in names), *own], [*names, *added])

    schema = StructType([docs.schema[n] for n in names]).add("piece", IntegerType()).add("start", LongType()).add("length", LongType()).add("ids_crc32", LongType())
    return docs.mapInArrow(work, schema.add("ids", BinaryType()) if keep_ids else schema)


class Bins:
    """A fixed number of open bins. Bit f of `bits` is set where a bin with f free places is open; `free[f]` lists those.
    A piece goes to the bin it leaves least free in; where none takes it a bin is opened, and the fullest closes first."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most, self.bits, self.open, self.made = capacity, most, 0, 0, 0
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def taken(self, f: int) -> int:
        """Takes out a bin with f free places."""
        number = self.free[f].pop()
        if not self.free[f]:
            self.bits &= ~(1 << f)
        self.open -= 1
        return number

    def place(self, n: int) -> tuple[int, int]:
        """(bin, offset) of a piece of n."""
        fits = self.bits >> n
        if fits:
            f = (fits & -fits).bit_length() - 1 + n
            number = self.taken(f)
        else:
            if self.open == self.most:
                self.taken((self.bits & -self.bits).bit_length() - 1)
            f, number = self.capacity, self.made
            self.made += 1
        if f > n:  # a full bin is closed
            self.free[f - n].append(number)
            self.bits |= 1 << (f - n)
            self.open += 1
        return number, self.capacity - f


def packed(lengths: Iterable[int], bins: Bins, window: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; each window of pieces is placed by falling length."""
    lengths = np.fromiter(lengths, dtype=np.int64)
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for at in range(0, len(lengths), window):
        for i in np.argsort(-lengths[at : at + window], kind="stable").tolist():
            out[at + i] = bins.place(int(lengths[at + i]))
    return out


@own_names
def pack(rows: DataFrame, length: str = "length", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, window: int = WINDOW, per_task: int = PER_TASK) -> DataFrame:
    """Adds sequence_id (any numbers) and offset to a table of pieces of 1 to `capacity`: pieces of one sequence stand one
    after another from 0 without a gap and reach `capacity` at most.

    Every task holds `open_bins` bins and a window of `window` pieces; there is a task for each `per_task` pieces, so that
    bins left open at a task's end are few beside its full ones. Pieces go to tasks by a hash of their row's number, so a
    hot document or source is spread. Rows whose length is null or out of bounds stay, with null for both; repeated rows are
    pieces of their own; an empty table gives an empty one; columns with the added names are replaced."""
    whole = durable(rows.drop("sequence_id", "offset").withColumn("_row", F.monotonically_increasing_id()))
    fits = F.coalesce(F.col(length).between(1, capacity), F.lit(False))
    rows = whole.where(fits)
    tasks = max(1, -(-rows.count() // per_task))
    names = whole.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = Bins(capacity, open_bins), TaskContext.get().partitionId() << 40

        def placed(table: pa.Table) -> Iterator[pa.RecordBatch]:
            own = np.array(packed(table.column(length).to_pylist(), bins, window), dtype=np.int64).reshape(-1, 2)
            table = table.append_column("sequence_id", pa.array(own[:, 0] + first)).append_column("offset", pa.array(own[:, 1]))
            yield from table.combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        for b in batches:
            while b.num_rows:
                room = window - sum(x.num_rows for x in held)
                held.append(b.slice(0, room))
                b = b.slice(room)
                if sum(x.num_rows for x in held) == window:
                    yield from placed(pa.Table.from_batches(held))
                    held = []
        if held:
            yield from placed(pa.Table.from_batches(held))

    dealt = rows.repartition(tasks, "_row").sortWithinPartitions(F.xxhash64("_row"), "_row")
    schema = StructType(list(rows.schema.fields)).add("sequence_id", LongType()).add("offset", LongType())
    none = F.lit(None).cast("long")
    out = dealt.mapInArrow(work, schema).unionByName(whole.where(~fits).withColumns({"sequence_id": none, "offset": none}))
    return out.select(*(c for c in names if c != "_row"), "sequence_id", "offset")


def sequences(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """sequence_id and tokens (array<int>) of packed pieces with their ids: a sequence holds `capacity` ids at most."""

    @F.pandas_udf("array<int>")
    def numbers(raw: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in raw], dtype=object)

    whole = F.array_sort(F.collect_list(F.struct("offset", ids)))
    joined = F.aggregate(F.transform(whole, lambda p: p[ids]), F.lit(b""), lambda a, x: F.concat(a, x))
    return rows.groupBy("sequence_id").agg(joined.alias("_ids")).select("sequence_id", numbers("_ids").alias("tokens"))
