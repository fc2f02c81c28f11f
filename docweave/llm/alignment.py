"""Alignment of the tokens that two tokenizers make of the same texts.

Both token sequences cover the same bytes. All tokens of a slice of documents are sorted by
start and their ends accumulate to a running maximum; a group ends where a start reaches it.
Tokens that overlap are expanded inside of their groups. Corpus-wide counts of linked id pairs
come back to the documents by blocks: a task numbers the distinct pairs of about
``BLOCK_LINKS`` links once, so that a frequent pair is one row a block and not one a link.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import map_groups, release, worker_cache
from docweave.session import store

#: Links of one block, and bytes of text that are tokenised at once; single documents may be longer.
BLOCK_LINKS, SLICE_BYTES = 1 << 20, 1 << 19
#: Distinct units that a Python worker remembers with their ids, and their characters in all.
MEMO_UNITS, MEMO_CHARS = 1 << 18, 1 << 22
#: A space between two characters that are surely no white space: both tokenizers cut before it.
_SOLID = r"[^\s\x00-\x20\x7F-\xBF\u180E\u200B-\u200F\u2060\uFEFF]"
_EDGE = re.compile(f"(?<={_SOLID}) (?={_SOLID})")
_LOW = (1 << 32) - 1


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1
    characters stand for themselves, the others follow from 256 on in their order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if chr(b) not in out]
    return out | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenPair:
    """A byte-level BPE tokenizer (A, its JSON) and a SentencePiece model (B, its proto)."""

    def __init__(self, byte_bpe: bytes, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_bpe.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        alphabet = byte_alphabet()
        special = {t["content"] for t in json.loads(byte_bpe).get("added_tokens", [])}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        ]
        self.size_a, self.size_b = (np.array([len(t) for t in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        # An id with what follows it in a group list: A id in a group, last A id, B id in a group, last B id.
        self.shown = [f"{i}{c}".encode() for v, c in ((self.bytes_a, ","), (self.bytes_a, "|"), (self.bytes_b, ","), (self.bytes_b, ";")) for i in range(len(v))]
        # No token of A spans an edge before a single space, and none of B unless a piece has the mark inside.
        apart = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(len(self.bytes_b)))
        self.split = _EDGE.split if apart else (lambda text: [text])
        self._forget()
        n = len(self.bytes_a)
        self.base = np.array([[0, n], [2 * n, 2 * n + len(self.bytes_b)]])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, their bounds per text, B ids, their bounds) of ``space + text`` by A and of
        ``text`` by B, which adds the space itself.

        Texts are encoded unit by unit; each distinct unit is encoded once while it is remembered.
        Null and empty texts, and those that a tokenizer changes, have no ids.
        """
        if len(self.codes) > MEMO_UNITS or self.chars > MEMO_CHARS:
            self._forget()
        units = [self.split(t) if t else () for t in texts]
        new = list({u for us in units for u in us if u not in self.codes})
        if new:
            self._learn(new)
        code = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(units)), np.int64, sum(map(len, units)))
        at = np.cumsum([0] + [len(us) for us in units])
        wrong = np.concatenate([[0], np.cumsum(~np.frombuffer(self.valid, bool)[code])])
        sound = np.diff(wrong[at]) == 0
        code = code[np.repeat(sound, np.diff(at))]
        at = np.concatenate([[0], np.cumsum(np.diff(at) * sound)])
        out = []
        for held, ends in zip(self.flat, self.ends, strict=True):
            end = np.array(ends, np.int64)
            many = np.diff(end)[code]
            before = np.concatenate([[0], np.cumsum(many)])
            take = np.arange(before[-1]) + np.repeat(end[code] - before[:-1], many)
            out += [np.frombuffer(held, np.int32)[take].astype(np.int64), before[at]]
        return tuple(out)

    def _learn(self, new: list[str]) -> None:
        """Encode units, and note which keep their bytes in both tokenizers."""
        spaced = [" " + u for u in new]
        lists = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)], self.b.encode(new, num_threads=1)
        data = [u.encode() for u in spaced]
        size, sound = np.fromiter(map(len, data), np.int64, len(data)), np.ones(len(data), bool)
        for k, (ids, table, sizes) in enumerate(zip(lists, (self.bytes_a, self.bytes_b), (self.size_a, self.size_b), strict=True)):
            flat, many = array("i", chain.from_iterable(ids)), np.fromiter(map(len, ids), np.int64, len(ids))
            end = np.cumsum(many)
            total = np.concatenate([[0], np.cumsum(sizes[np.frombuffer(flat, np.int32)])])[np.concatenate([[0], end])]
            if (np.diff(total) != size).any() or b"".join(map(table.__getitem__, flat)) != b"".join(data):
                sound &= [b"".join(map(table.__getitem__, x)) == d for x, d in zip(ids, data, strict=True)]
            self.ends[k].extend((end + len(self.flat[k])).tolist())
            self.flat[k].extend(flat)
        self.valid.extend(sound.tobytes())
        self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new)), strict=True))
        self.chars += sum(map(len, new))

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.chars, self.valid = 0, bytearray()
        self.flat, self.ends = (array("i"), array("i")), (array("q", [0]), array("q", [0]))


def token_pair(byte_bpe: bytes, piece_model: bytes) -> TokenPair:
    """The pair of a Python worker, loaded once."""
    held, key = worker_cache("token_pair"), (hashlib.sha256(byte_bpe).digest(), hashlib.sha256(piece_model).digest())
    if key not in held:
        held.clear()
        held[key] = TokenPair(byte_bpe, piece_model)
    return held[key]


def coalesce(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, pair: TokenPair) -> dict:
    """Groups and links of a slice of documents, given as ``TokenPair.encode`` returns them.

    ``n_groups`` and ``n_links`` per document; ``links`` as a id << 32 | b id in order of
    (document, A token, B token); ``codes`` index ``pair.shown`` in the order of the group
    list, ``at`` bounds those of each document; ``sizes`` has A and B tokens of every group.
    """
    n = len(at_a) - 1
    doc = np.concatenate([np.repeat(np.arange(n), np.diff(at)) for at in (at_a, at_b)])
    # The documents' bytes follow each other, the same for A and B, so no group passes an edge.
    ends = [np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])]
    starts = [ends[0] - pair.size_a[a], ends[1] - pair.size_b[b]]
    start, end, kind = np.concatenate(starts), np.concatenate(ends), np.repeat([0, 1], [len(a), len(b)])
    order = np.lexsort((kind, start))
    reached = np.maximum.accumulate(end[order])
    new = np.ones(len(order), bool)
    new[1:] = start[order][1:] >= reached[:-1]
    n_groups = np.bincount(doc[order][new], minlength=n)
    group = np.cumsum(new) - 1
    order = order[np.argsort(group * 2 + kind[order], kind="stable")]  # A before B inside of a group
    group, kinds = np.sort(group), kind[order]
    last = np.ones(len(order), np.int64)  # the last of its kind in its group
    last[:-1] = (group[1:] != group[:-1]) | (kinds[1:] != kinds[:-1])
    codes = pair.base[kinds, last] + np.concatenate([a, b])[order]
    at = np.searchsorted(doc[order], np.arange(n + 1))
    # Overlaps: the B tokens that end behind an A token's start and begin before its end.
    low, high = np.searchsorted(ends[1], starts[0], "right"), np.searchsorted(starts[1], ends[0], "left")
    many = high - low
    before = np.concatenate([[0], np.cumsum(many)])
    of_b = np.arange(before[-1]) - np.repeat(before[:-1] - low, many)
    links = np.repeat(a << 32, many) | b[of_b]
    total = int(group[-1]) + 1 if len(group) else 0
    sizes = [np.bincount(group[kinds == k], minlength=total) for k in (0, 1)]
    return {"n_groups": n_groups, "n_links": np.diff(before[at_a]), "links": links, "codes": codes, "at": at, "sizes": sizes}


def _text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(ids, texts) of about ``SLICE_BYTES``."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            ids.append(doc_id)
            texts.append(text)
            held += len(text or "")
            if held >= SLICE_BYTES or len(ids) >= 4000:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


_COUNTS = [(name, pa.int64()) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
_DETAIL = [(name, pa.list_(pa.int32())) for name in ("a_ids", "b_ids", "a_in_group", "b_in_group")]
_DETAIL_DDL = "a_ids array<int>, b_ids array<int>, a_in_group array<int>, b_in_group array<int>"


def _blocks(docs: DataFrame, files: tuple, detail: bool, block_links: int) -> DataFrame:
    """Rows of two kinds: documents with their links by number, and the numbered pairs of a block."""
    shared = docs.sparkSession.sparkContext.broadcast(files)
    kept = [("block", pa.int64()), *_COUNTS, ("groups_sha256", pa.string()), ("links", pa.binary())]
    schema = pa.schema([*kept, ("number", pa.int64()), ("pair", pa.int64()), ("n", pa.int64()), *(_DETAIL if detail else [])])
    pair_columns = ("block", "number", "pair", "n")

    def run(batches):
        pair = token_pair(*shared.value)
        block, rows, links, held = TaskContext.get().partitionId() << 32, [], [], 0

        def close():
            """The documents of a block, then its pairs."""
            found, number, n = np.unique(np.concatenate([np.empty(0, np.int64), *links]), return_inverse=True, return_counts=True)
            number = number.astype(np.uint16 if len(found) <= 1 << 16 else np.uint32)
            columns = {name: [] for name in schema.names} | {"block": [block] * len(rows)}
            done = 0
            for values in rows:
                for name, value in values.items():
                    columns[name].append(value)
                columns["links"].append(number[done : done + values["n_links"]].tobytes())
                done += values["n_links"]
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if columns[f.name] else pa.nulls(len(rows), f.type) for f in schema], schema=schema)
            own = {"block": np.full(len(found), block), "number": np.arange(len(found)), "pair": found, "n": n}
            for i in range(0, len(found), 50_000):
                some = [pa.array(own[f.name][i : i + 50_000], f.type) if f.name in pair_columns else pa.nulls(len(found[i : i + 50_000]), f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(some, schema=schema)

        for ids, texts in _text_slices(batches):
            a, at_a, b, at_b = pair.encode(texts)
            got = coalesce(a, at_a, b, at_b, pair)
            n_a, n_b = np.diff(at_a).tolist(), np.diff(at_b).tolist()
            at, codes = got["at"].tolist(), got["codes"].tolist()
            first = np.concatenate([[0], np.cumsum(got["n_groups"])])
            for i, doc_id in enumerate(ids):
                listed = b"".join(map(pair.shown.__getitem__, codes[at[i] : at[i + 1]]))[:-1]
                values = {
                    "doc_id": doc_id, "n_a": n_a[i], "n_b": n_b[i], "n_groups": int(got["n_groups"][i]), "n_links": int(got["n_links"][i]),
                    "groups_sha256": hashlib.sha256(listed).hexdigest() if listed else "",
                }
                if detail:
                    in_group = (s[first[i] : first[i + 1]] for s in got["sizes"])
                    values |= dict(zip(("a_in_group", "b_in_group"), in_group, strict=True)) | {"a_ids": a[at_a[i] : at_a[i + 1]], "b_ids": b[at_b[i] : at_b[i + 1]]}
                rows.append(values)
            links.append(got["links"])
            held += len(got["links"])
            if held >= block_links or len(rows) >= 20_000:
                yield from close()
                block, rows, links, held = block + 1, [], [], 0
        if rows:
            yield from close()
        rows, links = [], []
        release()

    counts = ", ".join(f"{name} bigint" for name, _ in _COUNTS)
    ddl = f"block bigint, {counts}, groups_sha256 string, links binary, number bigint, pair bigint, n bigint"
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, f"{ddl}, {_DETAIL_DDL}" if detail else ddl)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair in the corpus, and whether no pair of its B id has more."""
    counts = blocks.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("count"))
    b_id = F.col("pair").bitwiseAND(F.lit(_LOW))
    # One row for each id of B's vocabulary at most, so it may be broadcast.
    top = counts.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("top"))
    return counts.withColumn("b_id", b_id).join(F.broadcast(top), "b_id").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align(docs: DataFrame, byte_bpe: bytes, piece_model: bytes, detail: bool = False, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Token alignment of every document's text by two tokenizers, given as file contents.

    Returns (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), with
    ``detail`` also the ids and the number of A and B tokens in each group. ``n_best`` counts
    links whose id pair is the most frequent of its B id in the corpus (ties included),
    ``count_sum`` adds the corpus-wide counts of all links.

    Null and empty texts, and those that a tokenizer changes, have zeros and an empty digest.
    Texts have any length; a document is held whole by one task. A null ``doc_id`` stays,
    repeated rows give repeated results and count repeatedly, other columns are ignored. An
    empty table gives no rows.
    """
    blocks = store(_blocks(docs, (byte_bpe, piece_model), detail, block_links), "aligned")
    numbered = blocks.where("pair IS NOT NULL").select("block", "number", "pair").join(pair_counts(blocks), "pair")
    names = [name for name, _ in _COUNTS] + ["groups_sha256", *([name for name, _ in _DETAIL] if detail else [])]
    texts = blocks.where("pair IS NULL").select("block", "links", *names)
    both = texts.unionByName(numbered.select("block", "number", "count", "best"), allowMissingColumns=True)
    fields = [*_COUNTS, ("groups_sha256", pa.string()), *(_DETAIL if detail else [])]
    schema = pa.schema([*fields, ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def judge(key, rows):
        is_pair = rows["number"].is_valid()
        pairs, texts = rows.filter(is_pair), rows.filter(rows["number"].is_null())
        number = pairs["number"].to_numpy()
        count, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        count[number], best[number] = pairs["count"].to_numpy(), pairs["best"].to_numpy()
        kind = np.uint16 if len(number) <= 1 << 16 else np.uint32
        links = [np.frombuffer(x, kind) for x in texts["links"].to_pylist()]
        out = [texts[name].to_pylist() for name, _ in fields]
        return [*out, [int(best[x].sum()) for x in links], [int(count[x].sum()) for x in links]]

    ddl = ", ".join(f"{name} bigint" for name, _ in _COUNTS) + ", groups_sha256 string"
    ddl = f"{ddl}, {_DETAIL_DDL}" if detail else ddl
    return map_groups(both, ["block"], judge, schema, f"{ddl}, n_best bigint, count_sum bigint")
