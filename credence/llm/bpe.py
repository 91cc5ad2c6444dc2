"""Byte-level BPE encoding and decoding.

Texts are cut into pieces (letters, digits, other signs, white space) and a chunk of
documents into its distinct pieces and, for each document, the positions of its pieces
among them. The distinct pieces are encoded by a fold of ranked merges over their bytes: the
adjacent pair of lowest rank is merged until none is left. Decoding joins the tokens'
bytes. The documents are then put together again from the encoded pieces. Every step is
narrow: nothing is shuffled, and a chunk's size is bounded by its bytes (or by one
document, if that is longer).

The fold has two forms with equal results. `native` is an expression of Spark's
higher-order functions with a literal rank map; these run interpreted, 0.1 ms or so a
piece. `vectorized` folds all pieces of a chunk at once on arrays, with the same ranks,
and is what meets a budget on corpora with very many distinct words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm.common import documents
from credence.llm.tokens import load_ranks, pattern

#: Text bytes of a chunk; its distinct pieces are encoded once.
CHUNK_BYTES = 32 << 20
NO_RANK = 1 << 30
#: Buckets of the literal rank map: element_at scans a map, so each bucket is a small one.
BUCKETS = 1 << 16

_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"


@cache
def _splitters():
    """The piece patterns: the general one, and the same for texts of ASCII only."""
    ascii_space = r"\t\n\x0b\x0c\r "
    general = pattern().replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]")
    general = general.replace(r"\s+(?!\S)|\s+", rf"[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
    plain = general.replace(_SPACE, ascii_space).replace(r"[^" + ascii_space + r"\p{L}\p{N}]", rf"[^{ascii_space}A-Za-z0-9]")
    plain = plain.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    return regex.compile(general).findall, re.compile(plain).findall


def pieces(text: str) -> list[str]:
    general, plain = _splitters()
    return plain(text) if text.isascii() else general(text)


class _Numbered(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc ids, pieces of each document, positions, distinct pieces) for each chunk."""

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())),
            pa.array([b"".join(positions)], pa.binary()),
            pa.array([list(numbers)], pa.list_(pa.string())),
        ], names=["ids", "counts", "positions", "words"])

    ids, counts, positions, numbers, held = [], [], [], _Numbered(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sizes = pc.binary_length(part.column(1)).to_pylist()
            for key, text, size in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), sizes):
                own = pieces(text or "")
                ids.append(key)
                counts.append(len(own))
                positions.append(np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)).tobytes())
                held += size or 0
                if held >= CHUNK_BYTES:
                    yield row()
                    ids, counts, positions, numbers, held = [], [], [], _Numbered(), 0
    if ids:
        yield row()


# ---------------------------------------------------------------- the fold, on arrays


@cache
def _pair_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of mergeable pairs with the ranks of their bytes together; rank by byte."""
    ranks = load_ranks(path)
    pairs = {(left << 32) + right: rank for token, rank in ranks.items() for cut in range(1, len(token))
             if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None}
    keys = np.array(sorted(pairs), np.int64)
    return keys, np.array([pairs[k] for k in keys.tolist()], np.int64), np.array([ranks[bytes([b])] for b in range(256)], np.int64)


def merge_words(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, end to end, and how many each word has.

    A round merges in every word all places of its pair of lowest rank, left to right. If
    that could differ from merging the leftmost place alone and looking again, because
    a pair that arises has a still lower rank, only the leftmost is merged in that word.
    """
    keys, values, of_byte = _pair_table(path)

    def rank_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        asked = (left << 32) + right
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[at] == asked, values[at], NO_RANK)

    lengths = np.array([len(w) for w in words], np.int64)
    ids = of_byte[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), lengths)
    rank = np.full(len(ids), NO_RANK)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner] = rank_of(ids[inner], ids[inner + 1])
    done_ids, done_words = [], []
    while len(ids):
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
        over = low == NO_RANK
        if over.any():
            done_ids.append(ids[over])
            done_words.append(word[over])
            ids, word, rank, low = (x[~over] for x in (ids, word, rank, low))
            continue
        places = np.flatnonzero(rank == low)
        # of places in a row, which overlap, every other one
        run = np.flatnonzero(np.append(True, np.diff(places) != 1))
        places = places[(np.arange(len(places)) - np.repeat(run, np.diff(np.append(run, len(places))))) % 2 == 0]
        while True:
            merged = ids.copy()
            merged[places] = low[places]
            keep = np.ones(len(ids), bool)
            keep[places + 1] = False
            new_ids, new_word, new_rank = merged[keep], word[keep], rank[keep]
            at = np.cumsum(keep)[places] - 1
            touched = np.unique(np.concatenate([at, at - 1]))
            touched = touched[touched >= 0]
            same = (touched + 1 < len(new_ids)) & (new_word[touched] == new_word[np.minimum(touched + 1, len(new_ids) - 1)])
            new_rank[touched] = NO_RANK
            touched = touched[same]
            new_rank[touched] = rank_of(new_ids[touched], new_ids[touched + 1])
            lower = [new_word[touched[new_rank[touched] < low[keep][touched]]]]
            # a merged place right before another: its pair with the other's left half
            close = places[:-1][(np.diff(places) == 2) & (word[places[:-1]] == word[places[1:]])]
            lower.append(word[close[rank_of(low[close], ids[close + 2]) < low[close]]])
            early = np.unique(np.concatenate(lower))
            alone = np.append(True, word[places[1:]] != word[places[:-1]])
            several = np.isin(word[places], early) & ~alone
            if not several.any():
                break
            places = places[~several]
        ids, word, rank = new_ids, new_word, new_rank
    if not done_ids:
        return np.zeros(0, np.int64), lengths
    ids, word = np.concatenate(done_ids), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return ids[order], np.bincount(word, minlength=len(words))


# ---------------------------------------------------------------- the fold, as an expression

def rank_maps(ranks: dict[bytes, int]) -> list[dict[int, int]]:
    """Mergeable pairs, dealt over buckets: key of two ranks -> rank of their bytes together."""
    buckets: list[dict[int, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                buckets[(left * 31337 + right) % BUCKETS][(left << 32) + right] = rank
    return buckets


def literals(spark: SparkSession, path: str) -> DataFrame:
    """One row: the rank maps, and the bytes of each token by its rank."""
    ranks = load_ranks(path)
    by_rank = {rank: token for token, rank in ranks.items()}
    tokens = [bytearray(by_rank.get(k, b"")) for k in range(max(by_rank) + 1)]
    return spark.createDataFrame([(rank_maps(ranks), tokens)], "maps array<map<bigint,int>>, tokens array<binary>")


def _pair_rank(maps: Column, left: Column, right: Column) -> Column:
    bucket = F.get(maps, (left * 31337 + right) % BUCKETS)
    key = F.shiftleft(left.cast("bigint"), 32) + right
    return F.coalesce(F.try_element_at(bucket, key), F.lit(NO_RANK))


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once: a transform of an array of one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merge_all(maps: Column, start: Column) -> Column:
    """Token ids from the ids of single bytes: merge the leftmost pair of lowest rank, until none is left.

    The fold's state has the ids and the rank of each adjacent pair; a merge replaces one id
    and looks up its two neighbours only. When nothing can be merged the list of pair ranks
    is emptied and the steps that remain do nothing.
    """
    state = lambda ids, pairs: F.struct(ids.alias("ids"), pairs.alias("pairs"))
    none = F.array().cast("array<int>")
    # of the 63 bits of a number: a rank up to NO_RANK, and a place in the piece
    place_bits = 32

    def step(acc: Column, _: Column) -> Column:
        ids, pairs = acc["ids"], acc["pairs"]

        def merged(least: Column) -> Column:
            low = F.shiftright(least, place_bits).cast("int")

            def at(p: Column) -> Column:  # p: place of the pair, from 0
                joined = F.transform(ids, lambda x, i: F.when(i == p, low).when(i == p + 1, -1).otherwise(x))
                ranked = F.transform(pairs, lambda r, i: (
                    F.when(i == p - 1, _pair_rank(maps, F.get(ids, p - 1), low))
                    .when(i == p + 1, _pair_rank(maps, low, F.get(ids, p + 2))).when(i == p, -1).otherwise(r)))
                return state(F.array_remove(joined, -1), F.array_remove(ranked, -1))

            return F.when(low >= NO_RANK, state(ids, none)).otherwise(
                _let(least.bitwiseAND(F.lit((1 << place_bits) - 1)).cast("int"), at))

        ranked = F.transform(pairs, lambda r, i: F.shiftleft(r.cast("bigint"), place_bits) + i)
        return F.when(F.size(pairs) == 0, acc).otherwise(_let(F.array_min(ranked), merged))

    pairs = F.zip_with(F.slice(start, F.lit(1), F.size(start) - 1), F.slice(start, F.lit(2), F.size(start)),
                       lambda left, right: _pair_rank(maps, left, right))
    return F.when(F.size(start) < 2, start).otherwise(
        F.aggregate(F.sequence(F.lit(2), F.size(start)), state(start, pairs), step, lambda acc: acc["ids"]))


def _encoded(tokens: Column, ids: Column) -> Column:
    """What a document needs of a piece: its ids as text, their number, the bytes they decode to."""
    return F.struct(
        F.array_join(ids.cast("array<string>"), " ").alias("text"), F.size(ids).alias("n"),
        F.aggregate(ids, F.lit(b""), lambda acc, i: F.concat(acc, F.get(tokens, i))).alias("bytes"))


def encoded_chunks(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk of documents: ids, counts, positions, and the encoded distinct pieces."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    chunks = source.mapInArrow(_chunks, "ids array<bigint>, counts array<int>, positions binary, words array<string>")
    ranks = load_ranks(path)
    single = F.array(*[F.lit(ranks[bytes([b])]) for b in range(256)])
    table = literals(spark, path)

    def encode(word: Column) -> Column:
        digits = F.hex(F.encode(word, "utf-8"))
        start = F.transform(F.sequence(F.lit(1), F.octet_length(word)),
                            lambda i: F.get(single, F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int")))
        return merge_all(F.col("maps"), start)

    return (chunks.withColumn("maps", table.select("maps").scalar())
            .withColumn("tokens", table.select("tokens").scalar())
            .withColumn("ids_of_words", F.transform("words", encode))
            .select("ids", "counts", "positions",
                    F.transform("ids_of_words", lambda x: _encoded(F.col("tokens"), x)).alias("encoded")))


def _digests(ids, counts, where, texts, lengths, decoded) -> pa.RecordBatch:
    """Each document's n_tokens and digests from its pieces' places among the encoded ones."""
    counts = np.asarray(counts, np.int64)
    ends = np.cumsum(counts)
    rows = []
    for start, end in zip((ends - counts).tolist(), ends.tolist()):
        own = where[start:end]
        places = own.tolist()
        rows.append((int(lengths[own].sum()) if places else 0,
                     hashlib.sha256(b" ".join(map(texts.__getitem__, places))).hexdigest(),
                     hashlib.sha256(b"".join(map(decoded.__getitem__, places))).hexdigest()))
    n, ids_sha, decoded_sha = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)],
                                      names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From chunks whose pieces Spark has encoded."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, counts, positions, encoded = (batch.column(i)[k] for i in range(4))
            parts = encoded.values
            yield _digests(ids.as_py(), counts.as_py(), np.frombuffer(positions.as_py(), np.int32), [x.encode() for x in parts.field("text").to_pylist()],
                           parts.field("n").to_numpy(), parts.field("bytes").to_pylist())


def _encode_chunks(path: str):
    """From documents, chunk by chunk, with the fold on arrays."""
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = {rank: token for token, rank in load_ranks(path).items()}
        names = [str(k).encode() for k in range(max(by_rank) + 1)]
        for chunk in _chunks(batches):
            ids, counts, positions, words = (chunk.column(i)[0] for i in range(4))
            tokens, lengths = merge_words([w.encode() for w in words.as_py()], path)
            tokens, ends = tokens.tolist(), np.cumsum(lengths).tolist()
            texts, decoded, start = [], [], 0
            for end in ends:
                own = tokens[start:end]
                texts.append(b" ".join(map(names.__getitem__, own)))
                decoded.append(b"".join(map(by_rank.__getitem__, own)))
                start = end
            yield _digests(ids.as_py(), counts.as_py(), np.frombuffer(positions.as_py(), np.int32), texts, lengths, decoded)

    return encoded


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", form: str = "vectorized") -> DataFrame:
    """Encode and decode each text: id, n_tokens, digests of the ids and of the decoded bytes.

    A null text is an empty one: no tokens, the digests of nothing. `form`: see the module.
    """
    schema = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if form == "native":
        found = encoded_chunks(docs, path, id_col, text_col).mapInArrow(_documents, schema)
    elif form == "vectorized":
        source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
        found = source.mapInArrow(_encode_chunks(path), schema)
    else:
        raise ValueError("The form must be `vectorized` or `native`.")
    return found.select(F.col("id").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
