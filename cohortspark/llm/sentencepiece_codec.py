"""SentencePiece models on the tokenizers library: the model file is parsed and rebuilt, and encodes in batches."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructType

# Fixed values of the model format: kinds of model and of pieces, and the mark of a space.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"


def default_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def parsed(model: bytes) -> Any:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    return proto


def merges_of(vocab: dict[str, int], scores: dict[str, float]) -> list[tuple[str, str]]:
    """Merge rules of a BPE model: every split of a piece into two pieces, in order of the merged piece's score; of
    one piece's splits, the one of the better left and right piece first."""
    out = []
    for piece, score in scores.items():
        own = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in vocab and piece[i:] in vocab]
        out += [(-score, vocab[a], vocab[b], a, b) for a, b in own]
    return [(a, b) for _, _, _, a, b in sorted(out)]


def rebuilt(model: bytes) -> Any:
    """A tokenizers.Tokenizer with the model's normaliser, space mark, pieces (unigram scores or merges) and byte
    fallback. It adds no control pieces."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    proto = parsed(model)
    spec, norm = proto.trainer_spec, proto.normalizer_spec
    pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
    vocab = {p: i for i, (p, _, _) in enumerate(pieces)}
    unk = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    if spec.model_type == UNIGRAM:
        worst = min(s for _, s, kind in pieces if kind == NORMAL) - 1000.0
        tok = Tokenizer(models.Unigram([(p, s if kind in (NORMAL, USER_DEFINED, UNKNOWN) else worst) for p, s, kind in pieces], unk_id=unk, byte_fallback=spec.byte_fallback))
    elif spec.model_type == BPE:
        scores = {p: s for p, s, kind in pieces if kind in (NORMAL, USER_DEFINED)}
        tok = Tokenizer(models.BPE(vocab=vocab, merges=merges_of(vocab, scores), unk_token=pieces[unk][0], fuse_unk=True, byte_fallback=spec.byte_fallback))
    else:
        raise ValueError(f"model type {spec.model_type} is neither unigram nor BPE")
    steps = []
    if norm.precompiled_charsmap:
        steps.append(normalizers.Precompiled(norm.precompiled_charsmap))
    if norm.remove_extra_whitespaces:
        steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
    if norm.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    steps.append(normalizers.Replace(" ", SPACE))
    tok.normalizer = normalizers.Sequence(steps)
    # No piece has a space mark behind another character, so a cut before each run of marks changes no result.
    if spec.split_by_whitespace and not any(SPACE in p.lstrip(SPACE) for p, _, kind in pieces if kind == NORMAL):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
    tok.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if norm.add_dummy_prefix else [])])
    own = [AddedToken(p, normalized=False, special=False) for p, _, kind in pieces if kind == USER_DEFINED]
    if own:
        tok.add_tokens(own)
    return tok


class Codec:
    """Encoder and decoder of one Python worker.

    Where no piece spans words, the words of a batch that are not yet in the memo are encoded by one call, which
    shares them among its threads; texts are then put together from the memo. Else whole texts are encoded."""

    MEMO = 100_000  # words held; beyond, the memo starts anew

    def __init__(self, model: bytes, threads: int) -> None:
        os.environ.update(RAYON_NUM_THREADS=str(threads), TOKENIZERS_PARALLELISM="true" if threads > 1 else "false")
        from tokenizers import normalizers

        self.whole, proto = rebuilt(model), parsed(model)
        norm = proto.normalizer_spec
        self.by_word = self.whole.pre_tokenizer is not None and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and not any(p.type == USER_DEFINED for p in proto.pieces)
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        if self.by_word:  # the memo's words are normalised
            self.whole.normalizer = normalizers.Sequence([])
        self.word, self.memo = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), {}
        self.sizes: dict[str, int] = {}
        self.marked = [p.piece.startswith(SPACE) for p in proto.pieces]
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(e.ids if t else [], dtype=np.int32) for t, e in zip(texts, self.whole.encode_batch_fast(texts, add_special_tokens=False), strict=True)]
        split = [self.word.findall(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = set().union(*split)
        if len(self.memo) + len(fresh) > self.MEMO:
            self.memo = {}
        self.learn(fresh.difference(self.memo))
        known = self.memo.__getitem__
        return [np.array(list(chain.from_iterable(map(known, words))), dtype=np.int32) for words in split]

    def counts(self, texts: list[str]) -> list[int]:
        """Numbers of ids only. The memo of counts holds numbers in place of lists, so ten times as many words."""
        if not self.by_word:
            return [len(e.ids) if t else 0 for t, e in zip(texts, self.whole.encode_batch_fast(texts, add_special_tokens=False), strict=True)]
        split = [self.word.findall(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = set().union(*split)
        if len(self.sizes) + len(fresh) > 10 * self.MEMO:
            self.sizes = {}
        self.sizes.update((w, len(ids)) for w, ids in self.ids_of(fresh.difference(self.sizes)))
        return [sum(map(self.sizes.__getitem__, words)) for words in split]

    def learn(self, words: set[str]) -> None:
        self.memo.update(self.ids_of(words))

    def ids_of(self, words: set[str]) -> Iterator[tuple[str, list[int]]]:
        """Encodes words. Those with one mark, at their head, go many to a text; each begins at a piece with a mark."""
        plain, odd = [], []
        for w in words:
            (plain if w[0] == SPACE and len(w) > 1 and SPACE not in w[1:] else odd).append(w)
        yield from zip(odd, (e.ids for e in self.whole.encode_batch_fast(odd, add_special_tokens=False)), strict=True)
        groups = [plain[i : i + 512] for i in range(0, len(plain), 512)]
        for group, e in zip(groups, self.whole.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = e.ids
            heads = [i for i, x in enumerate(ids) if self.marked[x]]
            yield from zip(group, (ids[a:b] for a, b in zip(heads, [*heads[1:], len(ids)], strict=True)), strict=True)

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        try:
            text = out.decode()
        except UnicodeDecodeError:
            return self.whole.decode(ids.tolist(), skip_special_tokens=False)
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=1)  # a worker that goes on to another stage lets the last one's memo go
def codec(model: bytes, threads: int) -> Codec:
    return Codec(model, threads)


def encoded_part(texts: list[str | None], c: Codec) -> list[pa.Array]:
    """The columns ids, round_trip and n_tokens of some texts; nulls and 0 for a null text."""
    found = iter(c.encode([t for t in texts if t is not None]))
    own = [None if t is None else next(found) for t in texts]
    ends = np.cumsum([0, *(0 if x is None else len(x) for x in own)], dtype=np.int32)
    values = np.concatenate([x for x in own if x is not None] or [np.array([], np.int32)])
    missing = pa.array([x is None for x in own], pa.bool_())
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=missing)
    same = [None if x is None else c.decode(x) == t for x, t in zip(own, texts, strict=True)]
    return [ids, pa.array(same, pa.bool_()), pa.array(np.diff(ends).astype(np.int64))]


def token_counts(text: Column, model: bytes | None = None, threads: int = 1, rows: int = 256) -> Column:
    """Number of pieces of each text; 0 for null."""
    model = default_model() if model is None else model

    @F.pandas_udf("long")
    def counts(texts: pd.Series) -> pd.Series:
        c, whole = codec(model, threads), texts.fillna("").tolist()
        return pd.Series([n for at in range(0, len(whole), rows) for n in c.counts(whole[at : at + rows])], dtype="int64")

    return counts(text)


def decoded(ids: Column, model: bytes, threads: int = 1) -> Column:
    """Text of piece ids; null stays null."""

    @F.pandas_udf("string")
    def texts(rows: pd.Series) -> pd.Series:
        c = codec(model, threads)
        return pd.Series([None if r is None else c.decode(np.asarray(r)) for r in rows], dtype=object)

    return texts(ids)


def encode(docs: DataFrame, text: str = "text", model: bytes | None = None, threads: int = 2, keep_text: bool = True, rows: int = 256) -> DataFrame:
    """Adds ids, round_trip, whether the ids decode to the text again, and n_tokens; text goes if keep_text is false.

    Whole texts are encoded, `threads` at a time in each worker, and come back `rows` at a time, so that no worker
    holds the ids of a whole Arrow batch. Null texts have null ids and round_trip and 0 tokens; empty ones have no
    ids; repeated rows are encoded alike; an empty table gives an empty one; columns with the added names are
    replaced. round_trip is false where the model's normaliser changes a text or it holds the space mark itself."""
    model = default_model() if model is None else model
    docs = docs.drop("ids", "n_tokens", "round_trip")
    kept = docs if keep_text else docs.drop(text)
    names = kept.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, threads)
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                columns = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, *encoded_part(part.column(part.schema.get_field_index(text)).to_pylist(), c)], [*names, "ids", "round_trip", "n_tokens"])

    schema = StructType(list(kept.schema.fields)).add("ids", ArrayType(IntegerType())).add("round_trip", BooleanType()).add("n_tokens", LongType())
    return docs.mapInArrow(work, schema)
