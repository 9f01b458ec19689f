"""Packs of whole documents, and counting questions that packs ask the corpus.

Operators that need corpus-wide facts about millions of short-lived keys (n-grams, anchors,
windows) work on *packs*: some megabytes of documents in one compressed row, written once to
the shared folder. A pack sends its distinct keys, as plain arrays dealt out by their top
bits, to *buckets*; a bucket merges what all packs sent and answers each pack in the order
that it asked in. So a shuffle carries four to eight bytes a key instead of a row, and a
task holds one pack or one bucket at a time, whatever the input's size. Every key of every
document takes part. A key that is common reaches a bucket once a pack, not once an
occurrence, so hot keys need no special care.

Buckets grow in number with the data, packs too, but a pack's keys do not. So beyond 2 ** FAN
buckets keys travel in two steps: packs deal them to 2 ** FAN shelves; for each shelf, groups of some
2 ** FAN packs merge what they ask and deal it out to the shelf's buckets; answers come back
the same way. A row holds about a thousand keys at any size, and rows grow with the data, not with
its square.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialise, release

PACK = pa.schema([("pack", pa.int64()), ("body", pa.binary())])
ASK = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("keys", pa.binary()), ("extra", pa.binary())])
ASK_DDL = "bucket int, pack long, keys binary, extra binary"
ANSWER = pa.schema([("pack", pa.int64()), ("bucket", pa.int32()), ("answer", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
ANSWER_DDL = "pack long, bucket int, answer binary, n long, v long"
#: Bits of a bucket's number that one step deals by.
FAN = 10


def _write(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def read_pack(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(body)).read_all()


def packs(docs: DataFrame, *columns: str, size: int = 4 << 20) -> DataFrame:
    """``columns`` of ``docs`` in packs of about ``size`` bytes; a longer row is a pack of its own.

    Numbers of packs are drawn once, while the table is written, and only read after that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            yield batch_of({"pack": [uuid.uuid4().int >> 65], "body": [_write(pa.Table.from_batches(held))]}, PACK)

        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], schema=part.schema)
                held.append(part)
                n += part.get_total_buffer_size()
                if n >= size:
                    yield from out()
                    held, n = [], 0
        if held:
            yield from out()

    return materialise(docs.select(*columns).mapInArrow(run, "pack long, body binary"))


def shrink(keys: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def grow(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def bits_of(n_buckets: int) -> int:
    return max(1, (n_buckets - 1).bit_length())


def width_of(base: int, bits: int) -> int:
    """Bytes to send of a key; beyond one step the bits that buckets are told apart by come on top."""
    return min(8, base + (max(0, bits - FAN) + 7) // 8)


def shelf_bits(bits: int) -> int:
    """Bits that packs deal their keys by (found on the driver, and given to the workers)."""
    return min(bits, FAN)


def request_rows(pack: int, keys: np.ndarray, extra: np.ndarray | None, shelf: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows of ASK for sorted distinct ``keys`` (uint64), dealt by their top ``shelf`` bits."""
    b = (keys >> np.uint64(64 - shelf)).astype(np.int64)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(b)) + 1, [len(b)])) if len(b) else np.zeros(1, np.int64)
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    for i in range(0, len(spans), 512):
        part = spans[i : i + 512]
        yield batch_of({"bucket": [int(b[x]) for x, _ in part], "pack": [pack] * len(part), "keys": [shrink(keys[x:y], width) for x, y in part], "extra": [extra[x:y].tobytes() if extra is not None else b"" for x, y in part]}, ASK)


@dataclass(frozen=True)
class Rule:
    """How a question is answered. ``extra`` is an array of ``kind`` beside the keys, ``n`` how many keys each sender has.

    ``answer(keys, extra, n)`` gives an array aligned with the keys; ``merge(keys, extra)`` the
    sorted distinct keys and what they ask together; ``hand(keys, extra, n, of_group)`` turns the
    answers to a group (aligned with the keys) into those of its senders."""

    kind: type
    answer: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    hand: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray] = lambda keys, extra, n, of_group: of_group


def counted(keys: np.ndarray, extra: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each key the sum of the counts that were sent with it."""
    _, inverse = np.unique(keys, return_inverse=True)
    return np.bincount(inverse, extra).astype(np.int64)[inverse]


def summed(keys: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(inverse, extra, len(distinct)).astype(np.uint32)  # a group's texts have fewer words than that


def counting(of: Callable[[np.ndarray], np.ndarray]) -> Rule:
    """Corpus counts, as ``of`` shows them."""
    return Rule(np.uint32, lambda keys, extra, n: of(counted(keys, extra, n)), summed)


def answers(requests: DataFrame, width: int, bits: int, rule: Rule, write: Callable[[np.ndarray], bytes] = np.ndarray.tobytes, read: Callable[[bytes], np.ndarray] | None = None, tally: Callable[[np.ndarray, np.ndarray], tuple[int, int]] | None = None) -> DataFrame:
    """Answers by pack and shelf (see ANSWER). With ``tally`` each bucket adds a row without a pack that
    holds two numbers of (keys, answers)."""
    sub = max(0, bits - FAN)

    def sent(t: pa.Table):
        keys = t.column("keys").to_pylist()
        return grow(b"".join(keys), width), np.frombuffer(b"".join(t.column("extra").to_pylist()), rule.kind), np.array([len(x) // width for x in keys])

    def rows(packs, buckets, got, n):
        cut = np.concatenate(([0], np.cumsum(n)))
        return {"pack": packs, "bucket": buckets, "answer": [write(got[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)], "n": [0] * len(n), "v": [0] * len(n)}

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pack")
        keys, extra, n = sent(t)
        got = rule.answer(keys, extra, n)
        out = rows(t.column("pack").to_pylist(), t.column("bucket").to_pylist(), got, n)
        if tally:
            for name, x in zip(out, (None, out["bucket"][0], None, *tally(keys, got)), strict=True):
                out[name].append(x)
        return pa.table(out, schema=ANSWER)

    if not sub:
        return requests.groupBy("bucket").applyInArrow(run, ANSWER_DDL)

    def places(keys):
        """The order that sorts keys by bucket, and the buckets (low bits, below a shelf) in it."""
        fine = (keys & np.uint64((1 << sub) - 1)).astype(np.int64)
        order = np.argsort(fine, kind="stable")
        return order, fine[order]

    def deal(t: pa.Table) -> pa.Table:
        keys, extra = rule.merge(*sent(t)[:2])
        order, fine = places(keys)
        keys, extra = keys[order], extra[order]
        cut = np.concatenate(([0], np.flatnonzero(np.diff(fine)) + 1, [len(fine)])).tolist()
        spans, shelf = list(zip(cut[:-1], cut[1:], strict=True)), t.column("bucket")[0].as_py()
        return pa.table({"bucket": [(shelf << sub) + int(fine[x]) for x, _ in spans], "pack": [t.column("part")[0].as_py()] * len(spans), "keys": [shrink(keys[x:y], width) for x, y in spans], "extra": [extra[x:y].tobytes() for x, y in spans]}, schema=ASK)

    def hand(asked: pa.Table, told: pa.Table) -> pa.Table:
        asked = asked.sort_by("pack")
        keys, extra, n = sent(asked)
        distinct, _ = rule.merge(keys, extra)
        got = np.concatenate([read(x) for x in told.sort_by("bucket").column("answer").to_pylist()])
        back = np.empty(len(distinct), got.dtype)
        back[places(distinct)[0]] = got
        got = rule.hand(keys, extra, n, back[np.searchsorted(distinct, keys)])
        return pa.table(rows(asked.column("pack").to_pylist(), asked.column("bucket").to_pylist(), got, n), schema=ANSWER)

    grouped = requests.withColumn("part", F.pmod("pack", F.lit(1 << sub)))
    told = grouped.groupBy("bucket", "part").applyInArrow(deal, ASK_DDL).groupBy("bucket").applyInArrow(run, ANSWER_DDL)
    if tally:
        told = materialise(told)
    back = told.where("pack IS NOT NULL").withColumn("shelf", F.shiftright("bucket", sub)).withColumnRenamed("pack", "of_part")
    out = grouped.groupBy("bucket", "part").cogroup(back.groupBy("shelf", "of_part")).applyInArrow(hand, ANSWER_DDL)
    return out.unionByName(told.where("pack IS NULL")) if tally else out


def put_together(rows: pa.Table, dtype) -> np.ndarray:
    """A pack's answers in the order of its sorted distinct keys."""
    if not rows.num_rows:
        return np.zeros(0, dtype)
    return np.frombuffer(b"".join(rows.sort_by("bucket").column("answer").to_pylist()), dtype)


def with_answers(pack_table: DataFrame, told: DataFrame, f: Callable[[int, pa.Table, pa.Table], Iterator[pa.Table]], schema: pa.Schema) -> DataFrame:
    """Run ``f(pack, documents, answers)`` on every pack."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [x for p, body in zip(left.column("pack").to_pylist(), left.column("body").to_pylist(), strict=True) for x in f(p, read_pack(body), right)]
        release()
        return pa.concat_tables(out) if out else schema.empty_table()

    return pack_table.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(run, from_arrow_schema(schema))


def over_packs(pack_table: DataFrame, f: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for p, body in zip(b.column("pack").to_pylist(), b.column("body").to_pylist(), strict=True):
                yield from f(p, read_pack(body))
        release()

    return pack_table.mapInArrow(run, schema)
