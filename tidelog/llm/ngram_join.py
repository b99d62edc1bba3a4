"""Exact Jaccard join on word shingles by prefix filters under several global token orders.

Two documents with Jaccard similarity of at least t share a token among the first n - ceil(t n) + 1 of either's n distinct
shingles, under whatever order of all tokens. Order A puts tokens first that only one set has, then rare ones (counts of all
shingles, hashed into a table of SKETCH counters; any counts make a valid order); orders B and C are hashes. So:

1. Documents with equal shingle sets form a class; one representative stays.
2. Shingles are exchanged in 32-bit form between units, which tells those that only one set has. A set with enough of its own has
   no other tokens in its prefix under order A, and is done.
3. Representatives that share prefix tokens, directly or through others, form a family (connected components, by SQL).
4. In each family, candidates share prefix tokens under A and B and C and fit in length; what remains is verified exactly on 64-bit
   shingles, one representative against all its candidates at a time. A family over SPLIT_TOKENS tokens is cut into blocks of
   representatives that look alike, each one compressed row, and blocks into groups; each pair of groups is a task, so no task
   holds more than two groups, and a block is sent once for each group that it meets. Two blocks without a common prefix token of
   representatives that fit in length don't meet, so sets that hang together by chains only stay apart.
5. Links give each document its component and its number of linked documents; copies count through their class.

No pair of documents ever is a row. Defined cases: null and empty texts have no shingles and link with nothing; texts with fewer
words than a shingle are one shingle of all their words; rows with one id are separate documents; a null id is smaller than all
others and returned as null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import common as C

WORDS, SHARE = 3, (90, 100)
SKETCH, CHUNK = 1 << 20, 1 << 16
#: Shingles that one group of a family's blocks holds at most, on average.
FAMILY_TOKENS = 1 << 21
#: Families with more shingles are cut into blocks whose number grows with the square root of the shingles over SPREAD, in groups
#: whose number grows with the cube root of it, so what is sent, compressed, grows with the family's power of 4/3 (with its square
#: beyond groups of FAMILY_TOKENS).
SPLIT_TOKENS, SPREAD = 1 << 17, 1 << 12
_B, _C, _SHORT = C.U64(0xB5297A4D3F84D5B5), C.U64(0xC2B2AE3D27D4EB4F), 0x5851F42D


class _Sets:
    """Distinct shingles of a unit's documents, or of some of them: hashes sorted within each document, bounds between documents."""

    def __init__(self, unit: C.Unit, n: int, at: np.ndarray | None = None):
        unit = unit if at is None else unit.only(at)
        words, _, _, bounds = unit.words(True)
        docs = len(unit.ids)
        count = np.diff(bounds)
        doc = np.repeat(np.arange(docs), count)
        m = max(0, len(words) - n + 1)
        whole = np.flatnonzero(doc[:m] == doc[n - 1 :]) if m else np.zeros(0, np.int64)
        h, d = C.gram_hashes(words, n)[whole] if m else np.zeros(0, C.U64), doc[whole] if m else whole
        few = np.flatnonzero((count > 0) & (count < n))
        if len(few):
            h = np.concatenate((h, C.mix(C.doc_hashes(words, bounds, 1)[few] + C.U64(_SHORT))))
            d = np.concatenate((d, few))
        order = _by_document(np.argsort(h), d)
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        self.token, self.doc = h[new], d[new]
        self.bounds = np.searchsorted(self.doc, np.arange(docs + 1))
        self.size = np.diff(self.bounds)
        self.rid = (unit.id << 16) + (np.arange(docs) if at is None else at)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        return C.doc_hashes(self.token, self.bounds, 1).view(np.int64), C.doc_hashes(self.token, self.bounds, 2).view(np.int64)

    def repeated(self, lg: int, replies: list | None) -> np.ndarray:
        """For each token whether several representatives have it."""
        distinct, back = np.unique(self.token, return_inverse=True)
        return C.answered(distinct, lg, replies)[back]

    def prefix(self, counts: np.ndarray, share: tuple[int, int], often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, documents) of the prefixes under order A, without the tokens that nobody else has. Tokens of one count stay in order of their hashes."""
        key = (often.astype(np.int64) << 32) | counts[(self.token & C.U64(SKETCH - 1)).astype(np.int64)]
        order = _by_document(np.argsort(key, kind="stable"), self.doc)
        rank = np.arange(len(order)) - self.bounds[self.doc]
        keep = (rank < prefix_length(self.size, share)[self.doc]) & often[order]
        return self.token[order][keep], self.doc[keep]


def _by_document(order: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The order, with each document's entries together. Units have fewer than 2**16 documents."""
    return order[np.argsort(doc[order].astype(np.uint16), kind="stable")]


def prefix_length(n: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    num, den = share
    return n - (num * n + den - 1) // den + 1


def _blocks(family: DataFrame) -> DataFrame:
    """Adds block, unique in a family: representatives go by their smallest prefix token, so those that look alike stand together, and what is still too large by their number."""
    least = F.array_min(F.transform("prefix", lambda t: F.xxhash64(t)))
    family = family.withColumn("_bucket", F.when(F.col("blocks") > 1, F.pmod(least, F.col("blocks"))).otherwise(0).cast("long"))
    weight = family.where("blocks > 1").groupBy("label", "_bucket", "blocks").agg(F.sum("n").alias("_n"))
    mean = weight.groupBy("label").agg(F.sum("_n").alias("_all"))
    parts = weight.join(mean, "label").select("label", "_bucket", F.ceil(F.col("_n") * F.col("blocks") / F.col("_all")).alias("_parts"))
    sub = F.pmod(F.xxhash64("rid"), F.coalesce("_parts", F.lit(1)))
    return family.join(parts, ["label", "_bucket"], "left").select("rid", "n", "prefix", "label", "blocks", (F.shiftleft("_bucket", 32) + sub).alias("block"))


def _meetings(family: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(label, block, with): for each block of the families that are cut the blocks it must be compared with, itself among them: those with a common prefix token where the set sizes allow a link."""
    num, den = share
    touch = family.where("blocks > 1").select("label", "block", "n", F.explode("prefix").alias("token"))
    touch = touch.groupBy("label", "token", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    other = touch.select("label", "token", F.col("block").alias("with"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    meet = touch.join(other, ["label", "token"]).where((F.col("hi") * den >= F.col("lo2") * num) & (F.col("hi2") * den >= F.col("lo") * num))
    return meet.groupBy("label", "block").agg(F.collect_set("with").alias("with"))


def _dealt(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """A family's blocks, in turn, form groups. Each block once for every two groups, x and y, of which one holds it and the other, or the same, a block that it meets."""
    turn = Window.partitionBy("label")
    place = F.floor((F.row_number().over(turn.orderBy("block")) - 1) * F.col("groups") / F.count("*").over(turn))
    at = packed.select("label", "block").join(sizes, "label").select("label", "block", place.alias("group"))
    met = packed.select("label", "block", F.explode("with").alias("with")).join(at, ["label", "block"])
    met = met.join(at.select("label", F.col("block").alias("with"), F.col("group").alias("_other")), ["label", "with"])
    met = met.groupBy("label", "block", "group").agg(F.collect_set("_other").alias("_others"))
    out = packed.join(met, ["label", "block"]).withColumn("_other", F.explode("_others"))
    return out.withColumns({"x": F.least("group", "_other"), "y": F.greatest("group", "_other")}).drop("_other", "_others")


DESCRIBED = "doc_id long, rid long, a long, b long, n long, chunk int, body binary"


def _described(units: DataFrame, n: int) -> DataFrame:
    """In one pass a row a document (its digests and set size), and each task's counts of shingles by hash, in chunks of a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        total = np.zeros(SKETCH, np.int64)
        for u, _ in C.units_in(batches):
            s = _Sets(u, n)
            total += np.bincount((s.token & C.U64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            a, b = s.digests()
            yield pa.RecordBatch.from_pydict({"doc_id": u.ids, "rid": s.rid, "a": a, "b": b, "n": s.size, "chunk": pa.nulls(len(a), pa.int32()), "body": pa.nulls(len(a), pa.binary())})
        squeeze = zstandard.ZstdCompressor(1)
        for k in range(0, SKETCH, CHUNK):
            part = total[k : k + CHUNK]
            if part.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_pydict({"doc_id": none, "rid": none, "a": none, "b": none, "n": none, "chunk": pa.array([k // CHUNK], pa.int32()), "body": pa.array([squeeze.compress(part.astype("<u8").tobytes())], pa.binary())})

    return C.mapped(units, run, DESCRIBED)


def _sketch(chunks: DataFrame) -> np.ndarray:
    """The tasks' counts of all documents' shingles, added up."""

    def add(table: pa.Table) -> pa.Table:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        total = sum(np.frombuffer(open_.decompress(x), "<u8") for x in table["body"].to_pylist())
        return pa.table({"chunk": table["chunk"].slice(0, 1), "body": pa.array([np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())})

    out = np.zeros(SKETCH, np.uint32)
    for r in chunks.groupBy("chunk").applyInArrow(add, "chunk int, body binary").collect():  # SKETCH / CHUNK rows, 4 MB in all
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["body"], "<u4")
    return out


def components(edges: DataFrame, home: str) -> DataFrame:
    """(rid, label): rids that share a node, directly or through others, get the same label, their smallest rid. Labels spread over nodes and then jump, so long chains take a logarithmic number of rounds; each round is written."""
    spark = edges.sparkSession
    labels = C.written(edges.groupBy("rid").agg(F.min("rid").alias("label")), f"{home}/labels-0")
    before, k = None, 0
    while True:
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels
        before, k = total, k + 1
        node = edges.join(labels, "rid").groupBy("node").agg(F.min("label").alias("label"))
        spread = edges.join(node, "node").groupBy("rid").agg(F.min("label").alias("label"))
        up = spread.select(F.col("rid").alias("label"), F.col("label").alias("_next"))
        jumped = spread.join(up, "label", "left").select("rid", F.least("label", "_next").alias("label"))
        new = C.written(jumped, f"{home}/labels-{k}")
        C.dropped(spark, f"{home}/labels-{k - 1}")
        labels = new


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def _postings(ids: np.ndarray, docs: np.ndarray, types: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    return docs[order], np.searchsorted(ids[order], np.arange(types + 1))


def links(sets: list[np.ndarray], prefix_a: list[np.ndarray], share: tuple[int, int], side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j > i linked with it), in turn. side: only documents of different sides are compared, unless all have one."""
    num, den = share
    m = len(sets)
    size = np.array([len(s) for s in sets])
    bounds = np.concatenate(([0], np.cumsum(size)))
    token = np.concatenate(sets)
    types, ids = np.unique(token, return_inverse=True)
    doc = np.repeat(np.arange(m), size)
    keep = prefix_length(size, share)
    orders = []
    with np.errstate(over="ignore"):
        for key in (C.mix(types ^ _B), C.mix(types ^ _C)):
            by = np.lexsort((key[ids], doc))
            first = by[(np.arange(len(by)) - bounds[doc]) < keep[doc]]
            orders.append((ids[first], doc[first]))
    a_ids = [np.searchsorted(types, p) for p in prefix_a]
    orders.insert(0, (np.concatenate(a_ids), np.repeat(np.arange(m), [len(a) for a in a_ids])))
    lists = [_postings(i, d, len(types)) for i, d in orders]
    mine = [(i[o := np.argsort(d, kind="stable")], np.searchsorted(d[o], np.arange(m + 1))) for i, d in orders]
    flag = np.zeros(len(types), bool)
    one_side = side is None or (side == side[0]).all()
    for i in range(m - 1):
        ok = np.ones(m - i - 1, bool)
        for (docs, at), (own, own_at) in zip(lists, mine, strict=True):
            shared = np.zeros(m, bool)
            for x in own[own_at[i] : own_at[i + 1]]:
                shared[docs[at[x] : at[x + 1]]] = True
            ok &= shared[i + 1 :]
            if not ok.any():
                break
        if not ok.any():
            continue
        if not one_side:
            ok &= side[i + 1 :] != side[i]
        other = np.flatnonzero(ok) + i + 1
        other = other[(den * size[other] >= num * size[i]) & (den * size[i] >= num * size[other])]
        if not len(other):
            continue
        flag[ids[bounds[i] : bounds[i + 1]]] = True
        if len(other) * 4 > m - i:
            inter = np.add.reduceat(flag[ids[bounds[i + 1] :]], bounds[i + 1 : -1] - bounds[i + 1], dtype=np.int64)[other - i - 1]
        else:
            inter = np.array([np.count_nonzero(flag[ids[bounds[j] : bounds[j + 1]]]) for j in other.tolist()])
        flag[ids[bounds[i] : bounds[i + 1]]] = False
        yield i, other[den * inter >= num * (size[i] + size[other] - inter)]


LINKED = "rid long, linked long, root long"
PACKED = "label long, block long, with array<long>, rids binary, copies binary, sizes binary, tokens binary, heads binary, prefix binary"


def _result(fields: dict) -> pa.Table:
    """A table of LINKED and PACKED; columns not given are null."""
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    rows = len(next(iter(fields.values())))
    return pa.table({c: pa.array(fields[c], kinds[t]) if c in fields else pa.nulls(rows, kinds[t]) for c, t in (x.split() for x in f"{LINKED}, {PACKED}".split(", "))})


def _linked(rid: np.ndarray, copies: np.ndarray, sets: list, prefix: list, share: tuple[int, int], side: np.ndarray | None) -> pa.Table:
    """The representatives with a link, the number of documents linked with them here, and one representative for all that links join."""
    linked, union = np.zeros(len(rid), np.int64), _Union(len(rid))
    for i, js in links(sets, prefix, share, side):
        linked[i] += copies[js].sum()
        linked[js] += copies[i]
        for j in js.tolist():
            union.join(i, j)
    some = np.flatnonzero(linked)
    return _result({"rid": rid[some], "linked": linked[some], "root": rid[np.array([union.root(i) for i in some.tolist()], np.int64)]})


def _packed_block(table: pa.Table) -> pa.Table:
    """A block as one row. Near copies have most sorted hashes in common, so they compress well behind one another."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(3).compress
    lens = lambda c: np.array([len(x) // 8 for x in table[c].to_pylist()], np.int64).tobytes()
    body = lambda c: squeeze(b"".join(table[c].to_pylist()))
    fields = {c: table[c].to_pylist()[:1] for c in ("label", "block", "with")}
    fields |= {"rids": [table["rid"].to_numpy().tobytes()], "copies": [table["copies"].to_numpy().tobytes()]}
    return _result(fields | {"sizes": [lens("tokens")], "tokens": [body("tokens")], "heads": [lens("prefix")], "prefix": [body("prefix")]})


def _opened_block(row: dict) -> tuple[np.ndarray, np.ndarray, list, list]:
    """(rid, copies, sets, prefixes) of a packed block."""
    import zstandard

    cut = lambda c, n: np.split(np.frombuffer(zstandard.decompress(row[c]), C.U64), np.cumsum(np.frombuffer(row[n], np.int64))[:-1])
    return np.frombuffer(row["rids"], np.int64), np.frombuffer(row["copies"], np.int64), cut("tokens", "sizes"), cut("prefix", "heads")


def join(docs: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE, unit_bytes: int = C.UNIT_BYTES, family_tokens: int = FAMILY_TOKENS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, class_id): per document its set size, the smallest doc_id that links reach, the number of documents linked with it, and the smallest doc_id with an equal set. docs: doc_id, text."""
    spark = docs.sparkSession
    home = C.shared_dir(spark)
    size = C.text_bytes(docs)
    lg = C.parts_for(size / 6)
    units = C.bucketed(C.pack(docs, unit_bytes), f"{home}/units", "unit", min(C.BUCKETS, size // C.BUCKET_BYTES + 1))
    described = C.written(_described(units, words), f"{home}/described")
    shared = spark.sparkContext.broadcast(_sketch(described.where("chunk IS NOT NULL").select("chunk", "body")))  # SKETCH counters of 4 bytes
    rows = described.where("chunk IS NULL").select("doc_id", "rid", "a", "b", "n")
    classes = rows.where("n > 0").groupBy("a", "b").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    classes = C.written(classes, f"{home}/classes")

    reps = classes.groupBy(F.shiftright("rep", 16).alias("unit")).agg(F.collect_list(F.col("rep").bitwiseAND(65535).cast("int")).alias("reps"))
    reps = C.written(reps, f"{home}/reps")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, r in C.units_in(batches):
            token = _Sets(u, words, np.sort(r["reps"])).token
            if (out := C.key_rows(u.id, token, None, lg)) is not None:
                yield out

    often = C.per_unit(C.repeated_keys(C.mapped(units.join(reps, "unit"), send, C.KEYS_SCHEMA)), "often")
    told = C.written(often.join(reps, "unit"), f"{home}/told")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, r in C.units_in(batches):
            s = _Sets(u, words, np.sort(r["reps"]))
            token, doc = s.prefix(shared.value, share, s.repeated(lg, r["often"]))
            at = np.searchsorted(doc, np.arange(len(s.rid) + 1))
            full = np.flatnonzero(np.diff(at))
            for k in range(0, len(full), 512):
                some = full[k : k + 512]
                yield pa.RecordBatch.from_pydict({
                    "rid": pa.array(s.rid[some]), "n": pa.array(s.size[some], pa.int64()),
                    "prefix": pa.array([token[at[d] : at[d + 1]].view(np.int64) for d in some], pa.list_(pa.int64())),
                })

    found = C.written(C.mapped(units.join(told, "unit"), gather, "rid long, n long, prefix array<long>"), f"{home}/found")
    edges = found.select("rid", F.explode("prefix").alias("node"))
    # Each token stands for its smallest representative: near copies share most tokens, so what is left is a few rows each.
    hubs = edges.groupBy("node").agg(F.min("rid").alias("hub"))
    edges = C.written(edges.join(hubs, "node").select("rid", F.col("hub").alias("node")).distinct(), f"{home}/edges")
    labels = components(edges, f"{home}/families")
    sizes = found.join(labels, "rid").groupBy("label").agg(F.sum("n").alias("total"), F.count("*").alias("members"))
    pieces = F.greatest(F.ceil(F.col("total") / family_tokens), F.ceil(F.sqrt(F.col("total") / SPREAD)))
    pieces = F.when(F.col("total") > min(family_tokens, SPLIT_TOKENS), pieces).otherwise(1).cast("int")
    groups = F.greatest(F.ceil(F.col("total") / family_tokens), F.ceil(F.pow(pieces, F.lit(2 / 3)))).cast("int")
    sizes = C.written(sizes.where("members > 1").select("label", pieces.alias("blocks"), groups.alias("groups")), f"{home}/sizes")
    split = sizes.where("blocks > 1").limit(1).count() > 0
    family = found.join(labels.join(sizes.drop("groups"), "label"), "rid")
    if split:
        family = C.written(_blocks(family), f"{home}/blocks")
        family = family.join(_meetings(family, share), ["label", "block"], "left")
    else:
        family = family.select("*", F.lit(0).cast("long").alias("block"), F.lit(None).cast("array<long>").alias("with"))
    family = family.select("rid", "label", "block", "with", "prefix").join(classes.select(F.col("rep").alias("rid"), "copies"), "rid")
    family = family.select(F.shiftright("rid", 16).alias("unit"), F.struct(F.col("rid").bitwiseAND(65535).alias("at"), "label", "block", "with", "copies", "prefix").alias("m"))
    family = C.written(family.groupBy("unit").agg(F.collect_list("m").alias("members")), f"{home}/family")  # else units might be dealt anew, as the sum was

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, r in C.units_in(batches):
            members = sorted(r["members"], key=lambda m: m["at"])
            s = _Sets(u, words, np.array([m["at"] for m in members]))
            for k in range(0, len(members), 512):
                some = members[k : k + 512]
                cols = {c: pa.array([m[c] for m in some], pa.int64()) for c in ("label", "block", "copies")}
                cols["with"] = pa.array([m["with"] for m in some], pa.list_(pa.int64()))
                cols |= {"rid": pa.array(s.rid[k : k + 512]), "tokens": pa.array([s.token[s.bounds[d] : s.bounds[d + 1]].tobytes() for d in range(k, k + len(some))], pa.binary())}
                cols |= {"prefix": pa.array([np.array(m["prefix"], np.int64).tobytes() for m in some], pa.binary())}
                yield pa.RecordBatch.from_pydict(cols)

    # Shingles are shipped once, straight to the task that verifies the family or packs the block.
    member = C.mapped(units.join(family, "unit"), fetch, "label long, block long, copies long, with array<long>, rid long, tokens binary, prefix binary")

    def first(table: pa.Table) -> pa.Table:
        if table["with"][0].as_py() is not None:
            return _packed_block(table)
        sets = [np.frombuffer(x, C.U64) for x in table["tokens"].to_pylist()]
        prefix = [np.frombuffer(x, C.U64) for x in table["prefix"].to_pylist()]
        return _linked(table["rid"].to_numpy(), table["copies"].to_numpy(), sets, prefix, share, None)

    def second(table: pa.Table) -> pa.Table:
        rows = table.sort_by("block")
        parts = [_opened_block(r) for r in rows.to_pylist()]
        rid, copies = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        sets, prefix = ([x for p in parts for x in p[k]] for k in (2, 3))
        return _linked(rid, copies, sets, prefix, share, np.repeat(rows["group"].to_numpy(), [len(p[0]) for p in parts]))

    done = member.groupBy("label", "block").applyInArrow(first, f"{LINKED}, {PACKED}")
    if split:
        packed = C.written(done, f"{home}/packed")
        met = _dealt(packed.where("block IS NOT NULL"), sizes).groupBy("label", "x", "y").applyInArrow(second, f"{LINKED}, {PACKED}")
        done = packed.where("block IS NULL").unionByName(met)
    done = C.written(done.select("rid", "linked", "root"), f"{home}/links")
    C.unlisted(spark, f"{home}/units")
    for name in ("found", "edges", "family", *(("blocks", "packed") if split else ())):
        C.dropped(spark, f"{home}/{name}")
    linked = done.groupBy("rid").agg(F.sum("linked").alias("linked"), F.min("root").alias("root"))
    if split:
        roots = components(done.select("rid", F.col("root").alias("node")).union(done.select(F.col("root").alias("rid"), F.col("root").alias("node"))), f"{home}/roots")
        linked = linked.drop("root").join(roots.select("rid", F.col("label").alias("root")), "rid")
    known = classes.join(linked, classes["rep"] == linked["rid"], "left").select("a", "b", "low", "copies", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("root", "rep").alias("root"))
    lowest = known.groupBy("root").agg(F.min("low").alias("component"))
    known = known.join(lowest, "root").select("a", "b", "low", "component", (F.col("linked") + F.col("copies") - 1).alias("n_links"))
    out = rows.join(known, ["a", "b"], "left").withColumn("none", F.col("n") == 0)
    null = lambda c: F.when(c != C.NULL_ID, c)
    pick = lambda c: null(F.when(F.col("none"), F.col("doc_id")).otherwise(F.col(c)))
    return out.select(null(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), pick("component").alias("component_id"), F.when(F.col("none"), 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), pick("low").alias("class_id"))


def keep_one(docs: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """Of rows that link, directly or through others, the one with the smallest doc_id, a null one being smaller than all others; of several with this id any one. Rows that link with none stay, whatever their ids."""
    home = C.shared_dir(docs.sparkSession)
    rows = C.with_row_keys(docs, f"{home}/rows")
    found = join(rows.select(F.col(C.ROW).alias("doc_id"), "text"), words, share).select(F.col("doc_id").alias(C.ROW), "component_id")
    members = C.written(found.join(rows.select(C.ROW, F.col("doc_id").cast("long").alias("doc_id")), C.ROW), f"{home}/members")
    stay = members.groupBy("component_id").agg(F.min(F.struct("doc_id", C.ROW)).alias("least")).select(F.col(f"least.{C.ROW}").alias(C.ROW))
    gone = C.written(members.join(stay, C.ROW, "left_anti").select(C.ROW), f"{home}/gone")
    return rows.join(gone, C.ROW, "left_anti").select(*docs.columns)
