"""Cross-tokenizer alignment: how two tokenizers cut the same bytes, and which of their ids go together.

Both tokenizers see a space and the text. Byte offsets where tokens of both end cut the tokens into groups;
tokens of a group whose bytes overlap are linked. The number of documents that hold an id pair linked is
counted over the corpus, and each document is told the counts of its links.

Both tokenizers cut text at blanks: a space or line feed after a printable character begins a new
stretch for either (the byte-level pattern takes white space with what follows, and no piece of the
other vocabulary goes on into a blank: checked when it is loaded). So a pack's texts are cut into such
stretches, each distinct one is encoded and aligned once, all at a time in numpy: ends by cumsum,
common cuts by intersect1d, group labels by searchsorted, links by repeat. Texts that hold white
space beyond ASCII, or a stretch whose tokens do not spell it, are encoded whole.

Documents' distinct pairs are counted a task, then summed in a salted and a final shuffle, so a pair that
every document holds arrives once a task and salt. Packs ask for their pairs' counts by bucket and get
them back as arrays. The highest count of each id of the first tokenizer, at most its vocabulary, is
all that the driver gathers.

Null and empty texts, and texts that the tokens of either do not spell (byte for byte), have no tokens:
all columns 0, ``groups`` and its hash ''. Every row is a document: repeated rows, also of one doc_id, count
each and come back each; a null doc_id stays null. Further columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, bytes_of, gathered, materialise, release, small_batches, table
from .packs import _write as packed
from .packs import read_pack as unpacked
from .tokens import gather

#: Bytes of text in a pack, documents in a pack; documents held back for one batch of work.
PACK_BYTES, PACK_ROWS = 6 << 20, 16_384
#: Distinct pairs that a task counts before it hands them on; salts of the first sum.
HELD, SALTS = 1 << 21, 8
#: Pairs of a bucket, packs that ask a bucket together.
BUCKET, ASKING = 1 << 16, 1 << 10

#: Fixed value: characters that the byte-level pattern takes for white space, beyond ASCII.
WIDE_BLANK = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SOLID = np.array([c > 32 and c != 127 for c in range(256)])


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    characters for themselves, the other bytes in order for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """A tokenizer's ids of stretches, and the bytes of its tokens."""

    def __init__(self, spelled: list[bytes]):
        self.n = np.array([len(x) for x in spelled], np.int64)
        self.begin = np.cumsum(self.n) - self.n
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.names = np.array([str(i) for i in range(len(spelled))], object)

    def encoded(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches, one after the other, and how many each has."""
        ids = self.ids(stretches)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())), n

    def spells(self, ids: np.ndarray, n: np.ndarray, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which stretches (of ``size`` bytes of ``data``) their tokens spell."""
        per = np.add.reduceat(np.append(self.n[ids], 0), np.minimum(np.cumsum(n) - n, len(ids))) * (n > 0)
        same = per == size
        at = np.cumsum(size) - size
        mine = gather(self.bytes, self.begin[ids], self.n[ids])
        own = np.cumsum(per) - per
        ok = np.flatnonzero(same & (size > 0))
        differ = gather(mine, own[ok], size[ok]) != gather(data, at[ok], size[ok])
        same[ok] = np.add.reduceat(np.append(differ, False).astype(np.int64), np.cumsum(size[ok]) - size[ok]) == 0 if len(ok) else same[ok]
        return same


class ByteLevel(Side):
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        spelled = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            spelled[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        super().__init__(spelled)

    def ids(self, stretches: list[str]) -> list[list[int]]:
        out = []
        for i in range(0, len(stretches), 4096):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(stretches[i : i + 4096], add_special_tokens=False)]
        return out


class Pieces(Side):
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_file=path)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        #: Blanks that begin a stretch: none that a piece holds after another character.
        self.blanks = [c for c, mark in ((" ", "▁"), ("\n", "\n")) if not any(re.search(f"[^{mark}]{mark}", p) for p in pieces)]
        hexes = re.compile("<0x([0-9A-F]{2})>")
        super().__init__([bytes([int(m[1], 16)]) if self.processor.is_byte(i) and (m := hexes.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.lead = self.processor.piece_to_id("▁")

    def ids(self, stretches: list[str]) -> list[list[int]]:
        """The processor puts a space before a text: the stretch's own one, or one that goes again."""
        out = []
        for i in range(0, len(stretches), 4096):
            part = stretches[i : i + 4096]
            got = self.processor.encode([x[1:] if x.startswith(" ") else x for x in part], num_threads=1)
            out += [ids if x.startswith(" ") else ids[1:] for ids, x in zip(got, part, strict=True)]
        return out


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.width = len(self.b.n)
        self.cuts = np.isin(np.arange(256), [ord(c) for c in self.b.blanks])

    def stretches(self, texts: pa.Array, whole: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The stretches of all texts (null: empty) with a space before them, and where each text's begin;
        those marked ``whole`` are one, empty ones none."""
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.fill_null(texts, "").cast(pa.large_string()), pa.scalar(" ", pa.large_string()))
        data, at = bytes_of(spaced)
        data = data[:-8]
        begin = self.cuts[data]
        begin[1:] &= _SOLID[data[:-1]]
        begin[:1] = False
        some = np.diff(at) > 1
        if whole.any():
            inside = np.zeros(len(data) + 1, np.int64)
            np.add.at(inside, at[:-1][whole], 1)
            np.add.at(inside, at[1:][whole], -1)
            begin &= np.cumsum(inside[:-1]) == 0
        begin[at[:-1]] = True  # an empty text is a space, left out below
        start = np.flatnonzero(begin)
        values = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(np.append(start, len(data)).astype(np.int64)), pa.py_buffer(data)])
        cut = np.searchsorted(start, at)
        if not some.all():
            keep = np.repeat(some, np.diff(cut))
            values, cut = values.filter(pa.array(keep)), np.concatenate(([0], np.cumsum(np.diff(cut) * some)))
        return values, cut

    def aligned(self, stretches: list[str]) -> dict[str, np.ndarray]:
        """Of each stretch: whether both spell it, numbers of tokens, groups and links, its links' id
        pairs (``pairs`` by ``n_links``) and its groups as text, each group ended by a semicolon."""
        raw = [x.encode() for x in stretches]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        (a, n_a), (b, n_b) = self.a.encoded(stretches), self.b.encoded(stretches)
        good = self.a.spells(a, n_a, data, size) & self.b.spells(b, n_b, data, size)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b, size = n_a * good, n_b * good, size * good
        end_a, end_b = np.cumsum(self.a.n[a]), np.cumsum(self.b.n[b])
        cuts = np.intersect1d(end_a, end_b)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        first = np.searchsorted(end_b, end_a - self.a.n[a], side="right")
        after = np.searchsorted(end_b - self.b.n[b], end_a, side="left")
        n = np.where(self.a.n[a] > 0, after - first, 0)
        left = np.repeat(np.arange(len(a)), n)
        right = np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(left))
        pairs = a[left] * self.width + b[right]
        links = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(n_a)))]
        groups = np.searchsorted(cuts, np.concatenate(([0], np.cumsum(size))), side="right")
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        text = np.empty(len(a) + len(b), object)
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        names = np.concatenate((self.a.names[a], self.b.names[b]))
        ends = np.concatenate((np.where(last_a, "|", ",")[: len(a)], np.where(last_b, ";", ",")[: len(b)])).astype(object)
        text[:] = (names + ends)[order] if len(order) else []
        at = np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
        parts = text.tolist()
        shown = np.array(["".join(parts[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)] + [None], object)[:-1]
        return {"good": good, "n_a": n_a, "n_b": n_b, "n_groups": np.diff(groups), "n_links": np.diff(links), "pairs": pairs, "shown": shown}

    def pack(self, docs: pa.Table, with_groups: bool) -> dict[str, pa.Table]:
        """A pack of documents (doc_id, text): ``docs``, one row each; ``uses`` (stretch, times) by document;
        ``stretches`` with their number of links; ``links``, places among ``pairs``; and ``pairs`` with the number of documents."""
        texts = docs.column("text").combine_chunks()
        whole = pc.fill_null(pc.match_substring_regex(texts, WIDE_BLANK), False).to_numpy(zero_copy_only=False)
        while True:
            values, cut = self.stretches(texts, whole)
            coded = values.dictionary_encode()
            which, found = coded.indices.to_numpy().astype(np.int64), self.aligned(coded.dictionary.to_pylist())
            doc = np.repeat(np.arange(len(texts)), np.diff(cut))
            bad = np.zeros(len(texts), bool)
            bad[doc[~found["good"][which]]] = True
            if not (bad & ~whole).any():
                break
            whole = whole | bad  # its tokens may still spell the whole text
        row = {"doc_id": docs.column("doc_id")}
        for c in ("n_a", "n_b", "n_groups", "n_links"):
            total = np.concatenate(([0], np.cumsum(found[c][which])))
            row[c] = np.diff(total[cut])
        said = []
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            said.append("".join(found["shown"][which[x:y]].tolist())[:-1])
        row["groups_sha256"] = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in said]
        if with_groups:
            row["groups"] = pa.array(said, pa.large_string())
        n_stretches = max(len(coded.dictionary), 1)
        use, times = np.unique(doc * n_stretches + which, return_counts=True)
        in_doc, stretch = np.divmod(use, n_stretches)
        pairs, link = np.unique(found["pairs"], return_inverse=True)
        begin = np.cumsum(found["n_links"]) - found["n_links"]
        of_doc = np.repeat(in_doc, found["n_links"][stretch])
        held = np.unique(of_doc * max(len(pairs), 1) + gather(link, begin[stretch], found["n_links"][stretch]))
        n_docs = np.bincount(held % max(len(pairs), 1), minlength=len(pairs))[: len(pairs)]
        row["n_uses"] = np.bincount(in_doc, minlength=len(texts)).astype(np.int32)
        small = lambda x: pa.array(x.astype(np.int32))  # noqa: E731  places and counts within a pack
        return {
            "docs": pa.table(row),
            "uses": pa.table({"stretch": small(stretch), "times": small(times)}),
            "stretches": pa.table({"n_links": small(found["n_links"])}),
            "links": pa.table({"pair": small(link)}),
            "pairs": pa.table({"pair": pairs, "n_docs": n_docs}),
        }


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """The process's aligner; Spark reuses its Python workers from task to task."""
    return Aligner(a_path, b_path)


PARTS = ("docs", "uses", "stretches", "links", "pairs")
PACK = pa.schema([("pack", pa.int64()), *[(p, pa.binary()) for p in PARTS]])
PACK_DDL = "pack long, " + ", ".join(f"{p} binary" for p in PARTS)


def alignments(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """All documents (doc_id, text) aligned, in packs, written once to the shared folder. An input of fewer
    partitions than cores is dealt out first: encoding takes long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for b in gathered((b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)), PACK_ROWS, PACK_BYTES):
            got = own.pack(pa.Table.from_batches([b]), with_groups)
            yield batch_of({"pack": [uuid.uuid4().int >> 65]} | {p: [packed(got[p])] for p in PARTS}, PACK)
        release()

    x, cores = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), docs.sparkSession.sparkContext.defaultParallelism
    x = x if x.rdd.getNumPartitions() >= cores else x.repartition(cores)
    return materialise(x.mapInArrow(run, PACK_DDL))


def pair_counts(packs: DataFrame) -> DataFrame:
    """(pair, n): how many documents hold each pair linked; pair is A's id times B's vocabulary plus B's id.
    Written once; summed within tasks, by pair and salt, and by pair."""
    schema = pa.schema([("pair", pa.int64()), ("salt", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting, salt = [], [], 0, uuid.uuid4().int % SALTS  # any salt gives the same sums

        def summed():
            pair, at = np.unique(np.concatenate(keys), return_inverse=True)
            return pair, np.bincount(at, np.concatenate(counts), len(pair)).astype(np.int64)

        for b in batches:
            for body in b.column(0).to_pylist():
                t = unpacked(body)
                keys.append(t.column("pair").to_numpy())
                counts.append(t.column("n_docs").to_numpy())
                waiting += len(keys[-1])
                if waiting >= HELD:
                    pair, n = summed()
                    keys, counts, waiting = [pair], [n], len(pair)
                    if waiting >= HELD // 2:
                        yield batch_of({"pair": pair, "salt": np.full(len(pair), salt), "n": n}, schema)
                        keys, counts, waiting = [], [], 0
        if keys:
            pair, n = summed()
            yield batch_of({"pair": pair, "salt": np.full(len(pair), salt), "n": n}, schema)
        release()

    some = packs.select("pairs").mapInArrow(run, "pair long, salt int, n long")
    return materialise(some.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n")))


def highest(counts: DataFrame, width: int) -> np.ndarray:
    """The highest count of each id of A; one number an id of its vocabulary."""
    got = counts.groupBy(F.floor(F.col("pair") / width).alias("a")).agg(F.max("n").alias("n")).collect()
    out = np.zeros(max((r["a"] for r in got), default=0) + 1, np.int64)
    for r in got:
        out[r["a"]] = r["n"]
    return out


ROWS = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())]
ASK_DDL = "bucket int, part int, pack long, keys binary"
TOLD_DDL = "pack long, bucket int, counts binary"


def with_counts(packs: DataFrame, counts: DataFrame, top: np.ndarray, width: int, with_groups: bool = False) -> DataFrame:
    """One row a document: doc_id, numbers of tokens, groups and links, ``n_best``, ``count_sum`` and groups_sha256 (and ``groups``)."""
    from pyspark.sql.pandas.types import from_arrow_schema

    buckets = max(16, -(-counts.count() // BUCKET)) | 1
    parts = max(1, -(-packs.count() // ASKING))
    ask_schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("pack", pa.int64()), ("keys", pa.binary())])
    told_schema = pa.schema([("pack", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary())])
    schema = pa.schema(ROWS + [("groups", pa.string())] * with_groups)

    def dealt(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order that sorts pairs by bucket, and where buckets begin in it."""
        bucket = pairs % buckets
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, body in zip(*(b.column(c).to_pylist() for c in ("pack", "pairs")), strict=True):
                pairs = unpacked(body).column("pair").to_numpy()
                order, cut = dealt(pairs)
                some = np.flatnonzero(np.diff(cut)).tolist()
                if some:
                    yield batch_of({"bucket": some, "part": [pack % parts] * len(some), "pack": [pack] * len(some), "keys": [pairs[order[cut[k] : cut[k + 1]]].tobytes() for k in some]}, ask_schema)
        release()

    def tell(asked: pa.Table, known: pa.Table) -> pa.Table:
        pair, n = known.column("pair").to_numpy(), known.column("n").to_numpy()
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        got = [n[np.searchsorted(pair, np.frombuffer(x, np.int64))].tobytes() for x in asked.column("keys").to_pylist()]
        return pa.table({"pack": asked.column("pack"), "bucket": asked.column("bucket"), "counts": got}, schema=told_schema)

    def finish(pack: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for r in pack.to_pylist():
            t = {p: unpacked(r[p]) for p in PARTS}
            pairs = t["pairs"].column("pair").to_numpy()
            order, _ = dealt(pairs)
            n = np.zeros(len(pairs), np.int64)
            n[order] = np.frombuffer(b"".join(told.sort_by("bucket").column("counts").to_pylist()), np.int64)
            link, size = t["links"].column("pair").to_numpy(), t["stretches"].column("n_links").to_numpy()
            ends = np.cumsum(size, dtype=np.int64)
            sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], ends))])
            stretch, times = t["uses"].column("stretch").to_numpy(), t["uses"].column("times").to_numpy().astype(np.int64)
            cut = np.concatenate(([0], np.cumsum(t["docs"].column("n_uses").to_numpy(), dtype=np.int64)))
            best = (n == top[pairs // width]).astype(np.int64) if len(pairs) else n
            cols = {c: t["docs"].column(c) for c in t["docs"].column_names}
            for c, of_pair in (("n_best", best), ("count_sum", n)):
                cols[c] = np.diff(np.concatenate(([0], np.cumsum(sums(of_pair[link])[stretch] * times)))[cut])
            out.append(pa.table({f.name: pa.chunked_array([cols[f.name]]) if isinstance(cols[f.name], np.ndarray) else cols[f.name].cast(f.type) for f in schema}, schema=schema))
        release()
        return pa.concat_tables(out) if out else schema.empty_table()

    asked = packs.select("pack", "pairs").mapInArrow(ask, ASK_DDL)
    known = counts.withColumn("bucket", F.pmod("pair", F.lit(buckets)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    told = asked.groupBy("bucket", "part").cogroup(known.groupBy("bucket", "part")).applyInArrow(tell, TOLD_DDL)
    return packs.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(finish, from_arrow_schema(schema))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, with_groups: bool = False) -> DataFrame:
    import public_tokenizers

    a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    width = len(aligner(a_path, b_path).b.n)
    packs = alignments(docs, a_path, b_path, with_groups)
    counts = pair_counts(packs)
    return with_counts(packs, counts, highest(counts, width), width, with_groups)


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return align(table(spark, sf_dir, "documents"))
