"""Encoding into pieces with the n best segmentations, and decoding.

A text is a lattice: its characters are nodes, each piece that fits is an arc. The forward
Viterbi scores of the nodes are exact heuristics for a backward A-star search, which then
takes whole segmentations off its heap in the order of their scores.

The lattice falls apart at places that no piece of the vocabulary spans (before a space,
between letters and other characters). These units are searched one by one and remembered,
and the n best of a text are put together from them without loss: only the n - 1 units with
the closest second choice can differ from the best segmentation.
"""

from __future__ import annotations

import array
import heapq
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import slices, worker_cache

SPACE = "▁"
#: Scores are whole millionths of a natural logarithm, so that sums are exact.
UNIT = 1_000_000
#: Below the worst piece by so much is a character that has no piece.
UNKNOWN_PENALTY = 10 * UNIT
#: Units that a worker remembers, and their characters, before it forgets all of them: about 0.5 KB a unit.
MEMO, MEMO_CHARS = 200_000, 4_000_000
_NEVER = -(1 << 62)


@dataclass
class Vocabulary:
    """Pieces with integer scores, none above 0. ``surface`` has the text of each id, bytes
    for bytes; ``suffixes`` has all ends of pieces, with the score of whole ones."""

    ids: dict[str, int]
    scores: dict[str, int]
    byte_ids: list[int]
    unknown_id: int
    surface: list[bytes]
    longest: int = 1
    unknown_score: int = 0
    spanning: tuple[str, ...] = ()
    suffixes: dict[str, int | None] = field(default_factory=dict)
    name: str = ""
    fine: re.Pattern = field(default=re.compile(f"{SPACE}*(?:[^\\W_]+|(?:[^\\w{SPACE}]|_)+)|{SPACE}+"))
    coarse: re.Pattern = field(default=re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+"))

    def __post_init__(self):
        self.longest = max(map(len, self.ids), default=1)
        self.unknown_score = min(self.scores.values(), default=0) - UNKNOWN_PENALTY
        self.suffixes = {p[k:]: None for p in self.ids for k in range(1, len(p))} | self.scores
        self.score_of_id = np.zeros(len(self.surface), np.int64)
        for piece, i in self.ids.items():
            self.score_of_id[i] = self.scores[piece]
        spans = set()
        for piece in self.ids:
            body = piece.lstrip(SPACE)
            if SPACE in body:
                raise ValueError(f"piece {piece!r} goes over a space; units would not be exact")
            if body and len(self.fine.findall(body)) > 1:
                spans.update(a + b for a, b in zip(body, body[1:], strict=False) if len(self.fine.findall(a + b)) > 1)
        self.spanning = tuple(sorted(spans))

    def units(self, marked: str) -> list[str]:
        """Independent parts of a marked text, in order and without loss."""
        exact = not any(pair in marked for pair in self.spanning)
        return (self.fine if exact else self.coarse).findall(marked)


def load_vocabulary(model_path: str) -> Vocabulary:
    """Read a SentencePiece model. Unigram models keep their log-probabilities; BPE models
    hold merge ranks instead, which Zipf's law turns into log-probabilities, -ln(rank + 1)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    size = model.vocab_size()
    raw = {i: model.get_score(i) for i in range(size)}
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ranks = all(raw[i] <= 0 and raw[i] == int(raw[i]) for i in plain)
    log = {i: -math.log(1 - raw[i]) if ranks else raw[i] for i in plain}
    ids, surface, bytes_of = {}, [b""] * size, [model.unk_id()] * 256
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_of[int(piece[3:5], 16)] = i
            surface[i] = bytes([int(piece[3:5], 16)])
        elif i in log:
            ids[piece] = i
            surface[i] = piece.replace(SPACE, " ").encode()
        elif model.is_unknown(i):
            surface[i] = "\N{DOUBLE QUESTION MARK}".encode()
    scores = {p: min(0, round(log[i] * UNIT)) for p, i in ids.items()}
    return Vocabulary(ids, scores, bytes_of, model.unk_id(), surface, name=f"{model_path}:{size}")


def _arcs(unit: str, v: Vocabulary) -> list[list[tuple[int, int, str]]]:
    """Arcs into each node: (start, score, piece)."""
    into: list[list[tuple[int, int, str]]] = [[] for _ in range(len(unit) + 1)]
    score = v.scores.get
    for i in range(len(unit)):
        if unit[i] not in v.scores:
            into[i + 1].append((i, v.unknown_score, unit[i]))
        for j in range(i + 1, min(len(unit), i + v.longest) + 1):
            s = score(unit[i:j])
            if s is not None:
                into[j].append((i, s, unit[i:j]))
    return into


def _ids(pieces: list[str], v: Vocabulary) -> tuple[int, ...]:
    out: list[int] = []
    for piece in pieces:
        i = v.ids.get(piece)
        if i is not None:
            out.append(i)
        else:
            out.extend(v.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))
    return tuple(out)


def viterbi(units: set[str], v: Vocabulary, memo: dict[str, dict]) -> None:
    """Remember the best ids of each unit, and the loss of its second best.

    Units go in order, so that the forward scores of a common beginning are kept from one to
    the next. The second best leaves the best path at one node over its second-best arc, so
    the forward pass gives its loss as well.
    """
    get, ids_of, loss_of, unknown = v.suffixes.get, memo["ids"], memo["loss"], memo["unknown"]
    best, second, back, last = [0], [_NEVER], [0], ""
    for unit in sorted(units):
        n, k = len(unit), 0
        for a, b in zip(unit, last, strict=False):
            if a != b:
                break
            k += 1
        del best[k + 1 :], second[k + 1 :], back[k + 1 :]
        for j in range(k + 1, n + 1):
            top = low = _NEVER
            at = 0
            for i in range(j - 1, -1, -1):
                s = get(unit[i:j], 1)
                if s is None or s == 1:  # the end of a piece only, or of none
                    if i == j - 1 and unit[i] not in v.scores:
                        top, at = best[i] + v.unknown_score, i
                    if s == 1:
                        break
                    continue
                total = best[i] + s
                if total >= top:
                    low, top, at = top, total, i
                elif total > low:
                    low = total
            best.append(top)
            second.append(low)
            back.append(at)
        pieces, j, loss = [], n, -_NEVER
        while j:
            if second[j] > _NEVER and best[j] - second[j] < loss:
                loss = best[j] - second[j]
            i = back[j]
            pieces.append(unit[i:j])
            j = i
        pieces.reverse()
        ids_of[unit] = array.array("i", _ids(pieces, v)).tobytes()
        loss_of[unit] = loss
        if missing := sum(p not in v.ids for p in pieces):
            unknown[unit] = missing * v.unknown_score
        last = unit


def n_best(unit: str, v: Vocabulary, n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The n best segmentations, best first: A-star from the end, guided by Viterbi scores."""
    arcs = _arcs(unit, v)
    ahead = [0] * len(arcs)
    for j in range(1, len(arcs)):
        ahead[j] = max(ahead[i] + s for i, s, _ in arcs[j])
    heap, order, found = [(-ahead[-1], 0, len(unit), 0, None)], 0, []
    while heap and len(found) < n:
        _, _, j, done, path = heapq.heappop(heap)
        if not j:
            pieces = []
            while path:
                piece, path = path
                pieces.append(piece)
            found.append((done, _ids(pieces, v)))
            continue
        for i, s, piece in arcs[j]:
            order += 1
            heapq.heappush(heap, (-(done + s + ahead[i]), order, i, done + s, (piece, path)))
    return found


def _best_first(found: list, ids: bytes) -> list[tuple[int, tuple[int, ...]]]:
    """The same list led by the segmentation that Viterbi chose among equal ones."""
    first = (found[0][0], tuple(np.frombuffer(ids, np.int32).tolist()))
    return [first, *[f for f in found if f != first]][: len(found)]


def _combine(choices: list[tuple[int, list[int]]], n: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """The n smallest sums of one loss per unit; choices: (unit, losses in order, 0 first)."""
    sums: list[tuple[int, tuple[tuple[int, int], ...]]] = [(0, ())]
    for place, losses in choices:
        grown = [(total + loss, took + ((place, k),) if k else took) for total, took in sums for k, loss in enumerate(losses)]
        sums = sorted(grown)[:n]
    return sums


def _memory(v: Vocabulary, n: int) -> dict:
    memo = worker_cache(f"pieces:{v.name}:{n}")
    if not memo or len(memo["ids"]) > MEMO or memo["chars"] > MEMO_CHARS:
        memo.update(ids={}, unknown={}, loss={}, listed={}, chars=0)
    return memo


def encode_batch(texts: list[str | None], v: Vocabulary, n: int) -> list[tuple[int, np.ndarray, list]]:
    """``encode_units`` of each text; new units of all texts are searched together."""
    memo = _memory(v, n)
    units = [v.units(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    distinct = list(map(set, units))
    new = set().union(*distinct).difference(memo["ids"])
    memo["chars"] += sum(map(len, new))
    viterbi(new, v, memo)
    return [encode_units(u, d, v, n, memo) for u, d in zip(units, distinct, strict=True)]


def encode_text(text: str | None, v: Vocabulary, n: int) -> tuple[int, np.ndarray, list]:
    return encode_batch([text], v, n)[0]


def encode_units(units: list[str], distinct: set[str], v: Vocabulary, n: int, memo: dict[str, dict]) -> tuple[int, np.ndarray, list[tuple[int, list[tuple[int, int, tuple[int, ...]]]]]]:
    """(score, ids, alternatives) of a text.

    Alternatives are the next n - 1 segmentations: (score, changes), a change being (position
    in the best ids, ids replaced there, ids put instead).
    """
    ids_of, unknown, loss_of, listed = memo["ids"], memo["unknown"], memo["loss"], memo["listed"]
    found = list(map(ids_of.__getitem__, units))
    best = np.frombuffer(b"".join(found), np.int32)
    score = int(v.score_of_id[best].sum())
    if not unknown.keys().isdisjoint(distinct):
        score += sum(unknown.get(u, 0) for u in units)
    if n < 2 or not units:
        return score, best, []
    losses = list(map(loss_of.__getitem__, distinct))
    last = sorted(losses)[: n - 1][-1]
    wanted = sorted((loss, u) for loss, u in zip(losses, distinct, strict=True) if loss <= last < -_NEVER or loss < last)
    wanted = [u for _, u in wanted[: n - 1]]
    if not wanted:
        return score, best, []
    # Equal units differ in place only: the n - 1 first places of the wanted units suffice.
    places: list[tuple[int, int, str]] = []
    for u in wanted:
        k = -1
        for _ in range(min(n - 1, units.count(u))):
            k = units.index(u, k + 1)
            places.append((loss_of[u], k, u))
    places = sorted(places)[: n - 1]
    for _, _, u in places:
        if u not in listed:
            listed[u] = _best_first(n_best(u, v, n), ids_of[u])
    choices = [(k, [listed[u][0][0] - s for s, _ in listed[u]]) for _, k, u in places]
    at = {k: len(b"".join(found[:k])) // 4 for _, k, _ in places}
    out = []
    for loss, took in _combine(choices, n)[1:]:
        changes = [(at[k], len(found[k]) // 4, listed[units[k]][c][1]) for k, c in sorted(took)]
        out.append((score - loss, changes))
    return score, best, out


def decode_ids(ids: list[int], v: Vocabulary) -> str:
    """The text of a list of ids; broken byte runs become U+FFFD, one leading space goes."""
    text = b"".join(map(v.surface.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


ENCODED = (
    "doc_id bigint, ids array<int>, score double, decoded string, "
    "alternatives array<struct<score:double,changes:array<struct<at:int,replaced:int,ids:array<int>>>>>"
)
_CHANGE = pa.struct([("at", pa.int32()), ("replaced", pa.int32()), ("ids", pa.list_(pa.int32()))])
_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("score", pa.float64()), ("decoded", pa.string()),
        ("alternatives", pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(_CHANGE))]))),
    ]
)


def encode_n_best(docs: DataFrame, model_path: str, n: int = 4) -> DataFrame:
    """Best ids, score, decoded text and the next n - 1 segmentations of every document.

    One narrow pass; the vocabulary (its size does not depend on the data) is broadcast.
    Null and empty texts have no ids, score 0 and decode to ''. A null ``doc_id`` stays.
    Repeated rows give repeated results, other columns are ignored. Characters without a
    piece become their bytes. U+2581 in a text decodes to a space, as in SentencePiece.
    Texts of any length are encoded whole; equal scores come in a fixed order.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))

    def run(batches):
        v = vocabulary.value
        for batch in slices(batches, 256):
            ids, lengths, scores, decoded, more = [], [0], [], [], []
            for score, best, alternatives in encode_batch(batch.column(1).to_pylist(), v, n):
                ids.append(best)
                lengths.append(len(best))
                scores.append(score / UNIT)
                decoded.append(decode_ids(best.tolist(), v))
                more.append([{"score": s / UNIT, "changes": [dict(zip(("at", "replaced", "ids"), c, strict=True)) for c in cs]} for s, cs in alternatives])
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), flat)
            columns = [batch.column(0), lists, pa.array(scores), pa.array(decoded, pa.string()), pa.array(more, _SCHEMA.field(4).type)]
            yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)
