"""N-gram Jaccard join with a token-group matrix.

1. Every text becomes a set of shingle hashes; equal sets are one node.
2. Prefix filter: two sets as similar as the threshold share a token among the first
   few of each in one global order, rarest first (by a counter of fixed size over
   all tokens). Only tokens that two nodes share there go on; a task settles
   repeats within its batch itself and sends each token on once.
3. In a few rounds each node is held against the node that leads most of its tokens. A parity
   bitmap of each set gives an upper bound of any overlap; what that leaves is compared exactly,
   and what links so partitions similar documents into groups.
4. The matrix stores each group's token union (of the prefixes). The tokens of a node in that union, summed up, bound its
   overlap with every member; only if that could reach the threshold is the group opened: in parts of
   bounded size the members' bitmaps are looked through, and the closest member is compared
   exactly. Where it isn't similar, all members that their bitmaps leave are. Pairs inside a
   group, and further pairs with a group that a node is linked to, need no comparison.
5. Components of all links.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_bytes, discard, gram_hashes, slices, stored, word_hashes
from .components import components

WORDS, PERCENT = 5, 80
#: Slots of the token counter, and slots per row that it is sent in.
SLOT_BITS, CHUNK_BITS = 22, 14
#: Prefix tokens per part of the posting table; slots of the filter that keeps texts nobody asks for off the network.
TOKENS_PER_PART, FILTER_SLOTS = 200_000, 1 << 20
#: Prefix tokens that a mapper compares at once, and bytes of text that a worker has as Python objects: an executor's workers share what its heap leaves.
TOKENS_PER_BATCH, TEXT_AT_ONCE = 200_000, 1_000_000
#: Members per part of an opened group; bits of a bitmap per token of its set, at least.
MEMBERS_PER_PART, BITS_PER_TOKEN = 64, 1.7
#: Nodes with a part of a group each that a worker has as Python objects at once.
ROWS_AT_ONCE = 200
#: Rounds in which groups form; more of them leave fewer pairs of groups to look into.
ROUNDS = 2


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of `size` words, or of the whole sequence if shorter."""
    return np.unique(gram_hashes(words, min(size, len(words)))) if len(words) else words


def parity_bits(tokens: np.ndarray) -> bytes:
    """For each of a power of two of slots, whether an odd number of tokens falls in it."""
    size = 64
    while size < BITS_PER_TOKEN * len(tokens):
        size *= 2
    odd = np.bincount((tokens >> np.uint64(8)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def most_shared(a: bytes, n: int, b: bytes, m: int) -> int:
    """Upper bound of the overlap of sets of n and m tokens: each odd slot of the two together is a token that one lacks."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (n + m - int(np.bitwise_count(x ^ y).sum())) // 2


def _closeness(a: bytes, n: int, b: bytes, m: int, percent: int) -> float | None:
    """The greatest similarity that the bitmaps leave possible, or None if that is below the threshold."""
    both = most_shared(a, n, b, m)
    return both / (n + m - both) if 100 * both >= percent * (n + m - both) else None


def _need(n, percent: int):
    """Least overlap of a set of n with any set as similar as the threshold."""
    return -(-percent * n // 100)


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _set_reader(size: int, seed: int):
    """Kind 0: doc_id, n, node and check hash of each set. Kind 1: this task's count of tokens by slot, in chunks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, dtype=np.uint32)
        names = ["kind", "doc_id", "n", "node", "check", "raw"]
        for batch in slices(batches, "text", TEXT_AT_ONCE):
            sets = [shingles(word_hashes((t or b"").lower()), size) for t in column_bytes(batch, "text")]
            if sets:
                slots, n = np.unique(_slots(np.concatenate(sets)), return_counts=True)
                counts[slots] += n.astype(np.uint32)  # a task reads fewer tokens than overflow it
            keys = [xxhash.xxh3_128_intdigest(s.tobytes(), seed=seed) for s in sets]
            halves = np.array([(k >> 64, k & (2**64 - 1)) for k in keys], dtype=np.uint64).reshape(-1, 2)
            columns = [np.zeros(len(sets), np.int32), batch.column("doc_id"), np.array([len(s) for s in sets], np.int64)]
            columns = [*map(pa.array, columns), *(pa.array(h.view(np.int64)) for h in halves.T.copy()), pa.array(map(parity_bits, sets), pa.binary(), size=len(sets))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        chunks = counts.reshape(-1, 1 << CHUNK_BITS)
        used = np.nonzero(chunks.any(axis=1))[0]
        zeros = np.zeros(len(used), np.int64)
        columns = [np.ones(len(used), np.int32), zeros, zeros, used, zeros]
        raw = pa.array([zlib.compress(chunks[i].astype("<u4").tobytes(), 1) for i in used], pa.binary())
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), raw], names=names)

    return read


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk, its counts summed and put on a logarithmic scale; rows come sorted by chunk."""

    def out(chunk: int, total: np.ndarray) -> pa.RecordBatch:
        levels = (4 * np.log2(1.0 + total)).astype(np.uint8)  # 252 at most, for a 64-bit count
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([levels.tobytes()], pa.binary())], names=["node", "raw"])

    now, total = None, None
    for batch in batches:
        for chunk, raw in zip(batch.column("node").to_pylist(), batch.column("raw").to_pylist(), strict=True):
            if chunk != now:
                if now is not None:
                    yield out(now, total)
                now, total = chunk, np.zeros(1 << CHUNK_BITS, dtype=np.int64)
            total += np.frombuffer(zlib.decompress(raw), dtype="<u4")
    if now is not None:
        yield out(now, total)


def _posting_sender(size: int, percent: int, seed: int, levels: bytes, parts: int):
    """Rows (part, kind, pairs): 0 settled pairs, 1 pairs that wait for others, 2 tokens already known as shared."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(levels, dtype=np.uint8)
        tokens, nodes, places, held = [], [], [], 0
        for batch in slices(batches, "text", TEXT_AT_ONCE):
            for text in column_bytes(batch, "text"):
                s = shingles(word_hashes((text or b"").lower()), size)
                if len(s):
                    n = len(s) - _need(len(s), percent) + 1
                    rank = order[_slots(s)]
                    tokens.append(s[np.argsort(rank, kind="stable")[:n]])  # equal ranks stay in hash order
                    nodes.append(np.full(n, _node(s, seed), dtype=np.uint64))
                    places.append(np.arange(n, dtype=np.uint32))
                    held += n
                if held >= TOKENS_PER_BATCH:
                    yield _sent(np.concatenate(tokens), np.concatenate(nodes), np.concatenate(places), parts)
                    tokens, nodes, places, held = [], [], [], 0
        if held:
            yield _sent(np.concatenate(tokens), np.concatenate(nodes), np.concatenate(places), parts)

    return send


def _unique_pairs(tokens: np.ndarray, nodes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (token, node, place), sorted, and whether the token has two nodes."""
    at = np.lexsort((nodes, tokens))
    tokens, nodes, places = tokens[at], nodes[at], places[at]
    new = np.r_[True, (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])]
    tokens, nodes, places = tokens[new], nodes[new], places[new]
    same = np.r_[False, tokens[1:] == tokens[:-1]]
    return tokens, nodes, places, same | np.r_[same[1:], False]


def _sent(tokens: np.ndarray, nodes: np.ndarray, places: np.ndarray, parts: int) -> pa.RecordBatch:
    tokens, nodes, places, shared = _unique_pairs(tokens, nodes, places)
    first = np.r_[True, tokens[1:] != tokens[:-1]]
    rows: list[tuple[int, int, bytes]] = []
    for kind, at in ((0, shared), (1, ~shared), (2, shared & first)):
        t, n, p = tokens[at], nodes[at], places[at]
        # Settled pairs go anywhere; the others to the part of their token.
        part = ((n if kind == 0 else t) >> np.uint64(11)) % np.uint64(parts)
        by = np.argsort(part, kind="stable")
        t, n, p, part = t[by], n[by], p[by], part[by]
        cuts = np.r_[0, np.nonzero(part[1:] != part[:-1])[0] + 1, len(part)] if len(part) else np.zeros(1, int)
        rows += [(int(part[a]), kind, t[a:b].tobytes() + n[a:b].tobytes() + p[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, names=["part", "kind", "pairs"])


def _posting_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, node, place) of the tokens that two nodes share; rows come sorted by part."""

    def out(tokens: np.ndarray, nodes: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(tokens.view(np.int64)), pa.array(nodes.view(np.int64)), pa.array(places.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["token", "node", "place"])

    def settle(waiting: list[tuple], known: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if waiting:
            tokens, nodes, places, shared = _unique_pairs(*map(np.concatenate, zip(*waiting, strict=True)))
            if known:
                shared = shared | np.isin(tokens, np.concatenate(known))
            yield out(tokens[shared], nodes[shared], places[shared])

    part, waiting, known = None, [], []
    for batch in batches:
        for at, kind, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "pairs")), strict=True):
            if at != part:
                yield from settle(waiting, known)
                part, waiting, known = at, [], []
            n = len(raw) // 20
            row = (np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint64, n, 8 * n), np.frombuffer(raw, np.uint32, n, 16 * n))
            if kind == 0:
                yield out(*row)
            elif kind == 1:
                waiting.append(row)
            else:
                known.append(row[0])
    yield from settle(waiting, known)


def _comparer(size: int, percent: int, seed: int):
    """Of rows (a, b, text_a, text_b) the pairs of nodes whose sets are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_b", TEXT_AT_ONCE):
            keep = []
            for at, (a, b, *texts) in enumerate(zip(*(batch.column(c).to_pylist() for c in "ab"), column_bytes(batch, "text_a"), column_bytes(batch, "text_b"), strict=True)):
                x, y = (shingles(word_hashes((t or b"").lower()), size) for t in texts)
                same = _node(x, seed) == a % 2**64 and _node(y, seed) == b % 2**64  # else rows that only share an id with these
                both = len(np.intersect1d(x, y, assume_unique=True)) if same else 0
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(at)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return compare


def _node(tokens: np.ndarray, seed: int) -> int:
    return xxhash.xxh3_128_intdigest(tokens.tobytes(), seed=seed) >> 64


def _ceil(a: Column, b: int) -> Column:
    return F.ceil(a / b).cast("long")


def _needed(n: Column, other: Column, percent: int) -> Column:
    """Overlap that sets of n and `other` tokens need at least to be as similar as the threshold."""
    return _ceil(percent * (n + other), 100 + percent)


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs.

    A-Z is lower-cased; words are runs of non-blanks; a shorter text is one shingle of
    all its words. Sets link when 100 * intersection >= percent * union; an empty or
    null text has no shingle and links with nothing. Rows that share a doc_id are one
    document in the graph, linked by what either links to, and each comes out. A row without
    doc_id gets no component and links nothing. An empty table gives an empty result; other
    columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets, levels, seed = _read_sets(rows, words)
    real = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    nodes = stored(real.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")), "nodes")
    links = _links(rows, nodes, sets, levels, seed, words, percent)
    twice = real.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    own = real.join(twice.select("doc_id"), "doc_id", "left_semi").join(nodes.select("node", "rep"), "node").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(stored(links.unionByName(own), "links")).withColumnRenamed("id", "rep")
    labels = nodes.select("node", "rep").join(found, "rep", "left").select("node", F.coalesce("component", "rep").alias("component"))
    empty = (F.col("n") == 0) | F.col("doc_id").isNull()
    key = F.when(~empty, F.col("node"))
    joined = sets.drop("bits").withColumn("key", key).join(labels.withColumnRenamed("node", "key"), "key", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def _read_sets(rows: DataFrame, words: int) -> tuple[DataFrame, bytes, int]:
    """The table of sets, the level of every counter slot, and a seed under which no two sets share a node."""
    seed = 0
    while True:
        read = stored(rows.mapInArrow(_set_reader(words, seed), "kind int, doc_id long, n long, node long, check long, raw binary"), "sets")
        sets = read.where("kind = 0").select("doc_id", "n", "node", "check", F.col("raw").alias("bits"))
        clash = sets.groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low < high")
        if not clash.take(1):
            break
        seed += 1
    chunks = read.where("kind = 1").select("node", "raw").repartition("node").sortWithinPartitions("node").mapInArrow(_sum_chunks, "node long, raw binary")
    levels = np.zeros(1 << SLOT_BITS, dtype=np.uint8).reshape(-1, 1 << CHUNK_BITS)
    for row in chunks.collect():  # one byte per slot, however much is counted
        levels[row["node"]] = np.frombuffer(row["raw"], dtype=np.uint8)
    return sets, levels.tobytes(), seed


def _links(rows: DataFrame, nodes: DataFrame, sets: DataFrame, levels: bytes, seed: int, words: int, percent: int) -> DataFrame:
    """Links (a, b) between the smallest documents of nodes: enough of them to join all that are connected."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    parts = max(64, total * (100 - percent) // 100 // TOKENS_PER_PART)
    sent = rows.where(F.col("doc_id").isNotNull()).mapInArrow(_posting_sender(words, percent, seed, levels, parts), "part long, kind int, pairs binary")
    postings = sent.repartition("part").sortWithinPartitions("part").mapInArrow(_posting_reader, "token long, node long, place int")
    bits = nodes.select("node", "n", "bits")
    # after: tokens from this one on. If it is the first that two sets share, they share no more than either has after it.
    placed = postings.groupBy("token", "node").agg(F.min("place").alias("place")).join(nodes.select("node", "n"), "node")
    placed = stored(placed.select("token", "node", "n", (F.col("n") - F.col("place")).alias("after")), "placed")
    posts = stored(_lists(placed), "posts")
    discard(placed)
    near = groups = None
    for turn in range(ROUNDS):
        found = _verified(rows, nodes, _leads(posts, bits, turn, percent), seed, words, percent)
        near = found if near is None else near.unionByName(found)
        groups = components(near).withColumnsRenamed({"id": "node", "component": "grp"})
        before, posts = posts, _across(posts, groups)
        discard(before)
    opened = _opened_groups(posts, percent)
    left = stored(_left(_in_parts(opened, groups, bits), bits, percent), "left")
    far = _verified(rows, nodes, _closest(left), seed, words, percent)

    # Where the closest member isn't similar, all that are left; joined by then, a node and a group need no more.
    merged = components(near.unionByName(far)).withColumnsRenamed({"id": "node", "component": "now"})
    other = merged.withColumnsRenamed({"node": "target", "now": "then"})
    apart = F.coalesce("now", "node") != F.coalesce("then", "target")
    still = left.join(merged, "node", "left").join(other, "target", "left").where(apart).select("node", F.explode("left").alias("m")).select("node", F.col("m.other").alias("other"))
    rest = _verified(rows, nodes, still.distinct(), seed, words, percent)
    discard(posts, opened, left)
    rep = nodes.select("node", "rep")
    both = near.unionByName(far).unionByName(rest)
    both = both.join(rep.withColumnsRenamed({"node": "a", "rep": "ra"}), "a").join(rep.withColumnsRenamed({"node": "b", "rep": "rb"}), "b")
    return both.select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def _lists(posts: DataFrame) -> DataFrame:
    """One row for all tokens of a node that have the same nodes (a passage's, or a group of copies'), as one token of that weight.

    Lists of nodes are told apart by a hash; should two of them clash, there are more candidates, and none is lost.
    """
    hashes = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"h{i}") for i in range(2)]
    lists = posts.groupBy("token").agg(F.count("*").alias("c"), *hashes).select("token", "c", F.xxhash64("c", "h0", "h1").alias("list"))
    merged = posts.join(lists, "token").groupBy(F.col("list").alias("token"), "node").agg(
        F.first("n").alias("n"), F.max("after").alias("after"), F.count("*").alias("weight"), F.sum("c").alias("c")
    )
    central = F.sum("c").over(Window.partitionBy("node")) / F.col("n")
    return merged.select("token", "node", "n", "after", "weight", central.alias("central"), F.col("node").alias("grp"), F.lit(1).cast("long").alias("size"))


def _across(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """Posts with their groups of now, of the tokens that more than one group has."""
    sized = groups.join(groups.groupBy("grp").agg(F.count("*").alias("size")), "grp")
    posts = posts.drop("grp", "size").join(sized, "node", "left").withColumns({"grp": F.coalesce("grp", "node"), "size": F.coalesce("size", F.lit(1).cast("long"))})
    several = posts.groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low < high").select("token")
    return stored(posts.join(several, "token", "left_semi").select("token", "node", "n", "after", "weight", "central", "grp", "size"), "posts")


def _leads(posts: DataFrame, bits: DataFrame, turn: int, percent: int) -> DataFrame:
    """node and other: for each node the node of another group that leads most of its tokens, where they could be similar.

    Of a token's nodes one of the largest group leads. At first, when all are alone, it is the one whose tokens most nodes have: edits
    make tokens that no other has, so that is the text that the others were made from, if it is there. Then it is a matter
    of hash and turn, so that most tokens of a group of copies have the same leader, and another one each turn.
    """
    central = -F.col("central") if turn == 0 else F.lit(0.0)
    lead = F.struct((-F.col("size")).alias("s"), central.alias("c"), F.xxhash64(F.lit(turn), "node").alias("h"), *[F.col(c).alias(f"lead_{c}") for c in ("node", "n", "after", "grp")])
    first = posts.groupBy("token").agg(F.min(lead).alias("lead")).select("token", "lead.*")
    need = _needed(F.col("n"), F.col("lead_n"), percent)
    tries = posts.join(first, "token").where((F.col("grp") != F.col("lead_grp")) & (F.col("after") >= need) & (F.col("lead_after") >= need))
    counted = tries.groupBy("node", "lead_node").agg(F.sum("weight").alias("c"))
    best = counted.groupBy("node").agg(F.max(F.struct("c", "lead_node")).alias("best")).select("node", F.col("best.lead_node").alias("other"))
    theirs = bits.select(F.col("node").alias("other"), F.array(F.struct(F.col("node").alias("other"), "n", "bits")).alias("members"))
    return _closest(_left(best.join(theirs, "other").select("node", F.lit(0).cast("long").alias("target"), "members"), bits, percent))


def _opened_groups(posts: DataFrame, percent: int) -> DataFrame:
    """node and target: the groups that the token-group matrix leaves to be looked into for a node.

    The matrix has a group's token union (of prefix tokens), the sizes of the members that have a token, and how many tokens they have
    from it on. How many of a node's prefix tokens are in the union is what it can share with any member there; beyond
    the end of the shorter prefix two sets of n and m share at most need - 1 tokens, the larger need of theirs. So a
    group is opened if those tokens could make up what is missing for some size that its members have.

    Which pairs of a node and a group are looked up at all is told by the first token that they share: where the token before one, too,
    is the same in the node and in all of the group's members that have it, it isn't the first. From the first one on the node, and some
    member, must have as many tokens of other groups, too, as are missing.
    """
    order = Window.partitionBy("node").orderBy(F.desc("after"))
    from_here = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    posts = posts.withColumns({"prev": F.lag("token").over(order), "rest": from_here})
    matrix = stored(
        posts.groupBy("token", F.col("grp").alias("target")).agg(
            F.first("size").alias("target_size"),
            F.min("n").alias("low"),
            F.max("n").alias("high"),
            F.max("after").alias("most_after"),
            F.max("rest").alias("most_rest"),
            F.when((F.min("prev") == F.max("prev")) & (F.count("prev") == F.count("*")), F.min("prev")).alias("one_prev"),
        ),
        "matrix",
    )
    n = F.col("n")
    # Of two groups the members of the smaller one ask: they are the fewer rows.
    asks = (F.col("size") < F.col("target_size")) | ((F.col("size") == F.col("target_size")) & (F.col("grp") > F.col("target")))
    sized = (100 * F.col("high") >= percent * n) & (percent * F.col("low") <= 100 * n)
    later = F.coalesce(F.col("prev") == F.col("one_prev"), F.lit(False))
    low, high = F.greatest(F.col("low"), _ceil(percent * n, 100)), F.least(F.col("high"), F.floor(100 * n / percent).cast("long"))
    need = _needed(n, low, percent)
    # What is missing is least at one end of the sizes, but for rounding: below n it grows with the other's size, above it falls.
    missing = lambda m: _needed(n, m, percent) - F.greatest(_ceil(percent * n, 100), _ceil(percent * m, 100)) + 1
    least = F.least(missing(low), missing(high)) - 1
    met = posts.join(matrix, "token").where(asks & sized & ~later & (F.least("after", "most_after") >= need) & (F.least("rest", "most_rest") >= least))
    pairs = met.select("node", "target").distinct()
    shared = pairs.join(posts.select("node", "token", "n", "weight"), "node").join(matrix.select("token", "target", "low", "high"), ["token", "target"]).where(sized)
    overlap = shared.groupBy("node", "target").agg(F.first("n").alias("n"), F.sum("weight").alias("shared"), F.min("low").alias("low"), F.max("high").alias("high"))
    opened = stored(overlap.where((low <= high) & (F.col("shared") >= least)).select("node", "target"), "opened")
    discard(matrix)
    return opened


def _in_parts(opened: DataFrame, groups: DataFrame, bits: DataFrame) -> DataFrame:
    """node, target, members: each opened group in parts of about MEMBERS_PER_PART, however large it is."""
    alone = opened.select(F.col("target").alias("node")).distinct().join(groups, "node", "left_anti").select("node", F.col("node").alias("grp"))
    members = groups.select("node", "grp").join(opened.select(F.col("target").alias("grp")).distinct(), "grp", "left_semi").select("node", "grp").unionByName(alone)
    sizes = members.groupBy("grp").agg(F.ceil(F.count("*") / MEMBERS_PER_PART).cast("long").alias("parts"))
    dealt = members.join(sizes, "grp").join(bits, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    parts = dealt.groupBy(F.col("grp").alias("target"), "part").agg(F.collect_list(F.struct(F.col("node").alias("other"), "n", "bits")).alias("members"))
    return opened.join(parts, "target").select("node", "target", "members")


def _left(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """node, target, left: of the members those whose bitmap leaves a similarity at the threshold possible, with how much."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, len(b), ROWS_AT_ONCE)):
            rows = []
            for row in batch.to_pylist():
                close = [(m["other"], _closeness(row["bits"], row["n"], m["bits"], m["n"], percent)) for m in row["members"]]
                left = [{"other": other, "most": most} for other, most in close if most is not None]
                if left:
                    rows.append({"node": row["node"], "target": row["target"], "left": left})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    kind = pa.schema([("node", pa.int64()), ("target", pa.int64()), ("left", pa.list_(pa.struct([("other", pa.int64()), ("most", pa.float64())])))])
    return pairs.join(bits, "node").mapInArrow(look, "node long, target long, left array<struct<other: long, most: double>>")


def _closest(left: DataFrame) -> DataFrame:
    """node and other: the member left for each node and target with the greatest possible similarity, ties to the smaller node."""
    top = F.array_max(F.transform("left", lambda m: F.struct(m["most"].alias("most"), (-m["other"]).alias("minus"))))
    best = left.select("node", "target", top.alias("top")).groupBy("node", "target").agg(F.max("top").alias("top"))
    return stored(best.select("node", (-F.col("top.minus")).alias("other")), "pairs")


def _verified(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, seed: int, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are similar, from the texts of their smallest documents.

    Texts are smaller than sets, so it is they that travel, once by id and once with the other end of their pair.
    """
    rep = nodes.select("node", "rep")
    ends = pairs.select(F.col("node").alias("a"), F.col("other").alias("b"))
    ends = ends.join(rep.withColumnsRenamed({"node": "a", "rep": "doc_a"}), "a").join(rep.withColumnsRenamed({"node": "b", "rep": "doc_b"}), "b")
    ends = stored(ends, "ends")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_SLOTS)).alias("slot")
    slots = ends.select(slot("doc_a")).unionByName(ends.select(slot("doc_b"))).distinct()  # never more rows than slots
    texts = rows.withColumn("slot", slot("doc_id")).join(F.broadcast(slots), "slot", "left_semi").drop("slot")
    first = texts.select(F.col("doc_id").alias("doc_a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("doc_id").alias("doc_b"), F.col("text").alias("text_b"))
    both = ends.join(first, "doc_a").join(second, "doc_b").select("a", "b", "text_a", "text_b")
    links = stored(both.mapInArrow(_comparer(words, percent, seed), "a long, b long").distinct(), "links")
    discard(ends)
    return links
