"""Problem 7: documents of varying length in containers of a fixed number of tokens, with little unused space."""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path
from random import Random

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
CAPACITY = 2048
BLOCK, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 1500, 2, 2, 8, 30
#: Displaced documents that are tried in pairs at once.
PAIRED = 48
#: Containers filled to this share stay as they are when leftovers are packed once more.
FULL = 0.999
# The split pattern that goes with the vocabularies of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str):
    """The tokenizer in a file of ranks."""
    import tiktoken

    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


_ENCODERS: dict[str, object] = {}


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of each row; null and empty texts have 0."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = encoder(tokenizer)
        encode = _ENCODERS[tokenizer].encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=["doc_id", "tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, tokens int")


def best_fit(items: list[tuple[int, int]], capacity: int, bins: list[list] | None = None) -> list[list]:
    """Bins [free, members] after each item (size, key), in the given order, went to the fullest bin with room."""
    bins = bins if bins is not None else []
    room = sorted((b[0], k) for k, b in enumerate(bins) if b[0] > 0)
    for size, key in items:
        at = bisect_left(room, (size, -1))
        if at < len(room):
            _, k = room.pop(at)
        else:
            bins.append([capacity, []])
            k = len(bins) - 1
        b = bins[k]
        b[0] -= size
        b[1].append((size, key))
        if b[0] > 0:
            insort(room, (b[0], k))
    return bins


def fitness(bins: list[list], capacity: int) -> float:
    """Mean squared fill: few, full bins are best."""
    return sum(((capacity - b[0]) / capacity) ** 2 for b in bins) / len(bins) if bins else 0.0


def tightened(bins: list[list], loose: list[tuple[int, int]], capacity: int, draw: Random) -> list[tuple[int, int]]:
    """Fill bins better by exchanges: one or two of a bin's items for one or two loose ones that together take more of its
    room, and never more than all of it. Changes bins; the items that are loose then."""
    loose = sorted(loose)
    for b in sorted(bins, key=lambda x: -x[0]):
        better = True
        while b[0] > 0 and loose and better:
            better = False
            some = loose if len(loose) <= PAIRED else sorted(draw.sample(loose, PAIRED))
            pairs = sorted((x[0] + y[0], i, j) for i, x in enumerate(some) for j, y in enumerate(some[:i]))
            members = b[1]
            out = [(0, ())] + [(x[0], (x,)) for x in members] + [(x[0] + y[0], (x, y)) for i, x in enumerate(members) for y in members[:i]]
            best = (0, (), ())
            for size, gone in out:
                room = size + b[0]
                k = bisect_left(loose, (room + 1, -1)) - 1
                if k >= 0 and loose[k][0] - size > best[0]:
                    best = (loose[k][0] - size, gone, (loose[k],))
                k = bisect_left(pairs, (room + 1, -1, -1)) - 1
                if k >= 0 and pairs[k][0] - size > best[0]:
                    best = (pairs[k][0] - size, gone, (some[pairs[k][1]], some[pairs[k][2]]))
            if best[0] > 0:
                gain, gone, come = best
                b[0] -= gain
                b[1] = [x for x in members if x not in gone] + list(come)
                loose = sorted([x for x in loose if x not in come] + list(gone))
                better = True
    return loose


def fitted(bins: list[list], loose: list[tuple[int, int]], capacity: int, draw: Random) -> list[list]:
    """The bins with all loose items: first exchanges, then each item where it fits best, largest first."""
    loose = tightened(bins, loose, capacity, draw)
    return best_fit(sorted(loose, reverse=True), capacity, bins)


def crossed(a: list[list], b: list[list], capacity: int, draw: Random) -> list[list]:
    """The fuller bins of b put into a whole; bins of a that share an item with them are broken up, and their other
    items fitted in again."""
    picked = [x for x in b if draw.random() < 0.5 and x[0] <= 0.02 * capacity] or [min(b, key=lambda x: x[0])]
    taken = {i for x in picked for _, i in x[1]}
    kept, loose = [[x[0], list(x[1])] for x in picked], []
    for x in a:
        if any(i in taken for _, i in x[1]):
            loose += [t for t in x[1] if t[1] not in taken]
        else:
            kept.append([x[0], list(x[1])])
    return fitted(kept, loose, capacity, draw)


def mutated(bins: list[list], capacity: int, draw: Random) -> list[list]:
    """The least filled bins, and a few others, broken up and their items fitted in again."""
    order = sorted(bins, key=lambda x: -x[0])
    some = draw.randint(2, max(3, len(bins) // 20))
    loose = [t for x in order[:some] for t in x[1]]
    rest = []
    for x in order[some:]:
        if draw.random() < 2 / len(bins):
            loose += x[1]
        else:
            rest.append([x[0], list(x[1])])
    return fitted(rest, loose, capacity, draw)


def evolve(items: list[tuple[int, int]], capacity: int, seed: int, immigrant: list[list] | None = None, population: int = POPULATION, generations: int = GENERATIONS) -> list[list]:
    """The best grouping that a grouping genetic algorithm finds for items (size, key).

    It begins with best-fit of the falling sizes, the immigrant and best-fits of disturbed orders; each generation crosses
    one of the better half with another and mutates the child, and both take the places of the worst. It ends where no
    grouping can have fewer containers.
    """
    if not items:
        return []
    draw = Random(seed)
    least = -(-sum(s for s, _ in items) // capacity)
    rank = lambda x: (len(x), -fitness(x, capacity))
    pool = [best_fit(sorted(items, reverse=True), capacity), *([immigrant] if immigrant is not None else [])]
    if min(map(len, pool)) > least:
        while len(pool) < population:
            pool.append(best_fit(sorted(items, key=lambda t: -t[0] * (1 + 0.2 * draw.random())), capacity))
        for _ in range(generations):
            pool.sort(key=rank)
            if len(pool[0]) <= least:
                break
            a, b = draw.sample(range(len(pool)), 2) if draw.random() < 0.5 else (0, draw.randrange(1, len(pool)))
            child = crossed(pool[a], pool[b], capacity, draw)
            pool[-1], pool[-2] = mutated(child, capacity, draw), child
    return min(pool, key=rank)


def _islands(items: DataFrame, capacity: int, block: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """items: key, size, block -> key, size, block, bin, free, of the best island of each block."""
    kind = items.schema["key"].dataType.simpleString()
    schema = f"key {kind}, size int, block long, island int, bin int, free int, fit double"
    state = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumns({"bin": F.lit(None).cast("int"), "own": F.lit(True)})

    def stepper(epoch: int):
        def step(frame: pd.DataFrame) -> pd.DataFrame:
            own = frame[frame["own"]].sort_values("key")
            keys, sizes = own["key"].tolist(), own["size"].tolist()
            number = {k: i for i, k in enumerate(keys)}
            guest = None
            if epoch:
                guests: dict[int, list] = {}
                for k, s, b in frame[~frame["own"]].sort_values("key")[["key", "size", "bin"]].itertuples(index=False):
                    guests.setdefault(b, []).append((s, number[k]))
                guest = [[capacity - sum(s for s, _ in m), m] for m in guests.values()]
            island, at = int(frame["island"].iloc[0]), int(frame["block"].iloc[0])
            bins = evolve(list(zip(sizes, range(len(keys)))), capacity, seed + 1009 * at + 31 * island + epoch, guest)
            fit = fitness(bins, capacity)
            rows = [(keys[i], s, at, island, n, b[0], fit) for n, b in enumerate(bins) for s, i in b[1]]
            return pd.DataFrame(rows, columns=["key", "size", "block", "island", "bin", "free", "fit"])

        return step

    for epoch in range(epochs):
        done = cut(state.groupBy("block", "island").applyInPandas(stepper(epoch), schema))
        if epoch + 1 < epochs:  # each island sends its elite to the next one
            base = done.select("key", "size", "block", "island", "bin")
            state = base.withColumn("own", F.lit(True)).unionByName(base.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")).withColumn("own", F.lit(False)))
    best = done.groupBy("block", "island").agg((-F.max("bin")).alias("few"), F.max("fit").alias("fit")).groupBy("block").agg(F.max_by("island", F.struct("few", "fit", -F.col("island"))).alias("island"))
    return done.join(best, ["block", "island"]).select("key", "size", "block", "bin", "free")


def pack(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, block: int = BLOCK,
    islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 0,
) -> DataFrame:
    """(doc_id, part, tokens, container): every document in containers of `capacity` tokens.

    Method: grouping genetic algorithm on islands. Documents are hashed to blocks of about `block`; each block evolves
    on several islands, tasks of their own: crossover puts whole well-filled bins of one parent into the other,
    removes duplicates and fits the displaced documents in again, by exchanges with the documents of other bins and then
    by best fit; after each epoch every island's elite goes to the next island. Of each block the best island counts. Documents in bins that are not full then form new, fewer blocks and
    evolve once more. A document over the capacity is cut into full parts, each a container of its own, and a rest
    that is packed like a document; no other document is split.

    Defined cases: documents without tokens (null or empty text) have one part 0 of 0 tokens and no container. Rows of
    one id and text are one document each; repeated rows are packed each on their own, numbered by part only if they
    are split. An empty table gives an empty result. Other columns are not read. Only sizes and ids are moved; a block
    is bounded, whatever the number of documents. The result depends on the rows only, not on how they are partitioned.
    """
    counted = token_counts(documents, id_col, text_col, tokenizer).groupBy("doc_id", "tokens").agg(F.count(F.lit(1)).alias("n"))
    # the copies of an id and size are numbered, a thousand at a time, so that keys depend on the rows only
    copies = counted.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 1000))))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.col("a") * 1000, F.least(F.col("n"), F.col("a") * 1000 + 1000) - 1)))
    sized = cut(copies.select("doc_id", "tokens", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "tokens", "copy").alias("row")))
    full = sized.where(F.col("tokens") > capacity).select("doc_id", "row", "tokens", F.explode(F.sequence(F.lit(0), F.floor(F.col("tokens") / capacity).cast("int") - 1)).alias("part"))
    whole = full.select("doc_id", "part", F.lit(capacity).alias("tokens"), F.concat_ws("-", F.lit("full"), F.col("row").cast("string"), F.col("part").cast("string")).alias("container"))
    rest = F.when(F.col("tokens") > capacity, F.pmod("tokens", F.lit(capacity))).otherwise(F.col("tokens")).cast("int")
    part = F.when(F.col("tokens") > capacity, F.floor(F.col("tokens") / capacity)).otherwise(0).cast("int")
    pieces = sized.select("doc_id", F.col("row").alias("key"), part.alias("part"), rest.alias("size"))
    items = pieces.where("size > 0")
    blocks = max(1, round(items.count() / block))
    first = _islands(items.select("key", "size", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(blocks)).alias("block")), capacity, block, islands, epochs, seed)
    first = cut(first)
    loose = first.where(F.col("free") > (1 - FULL) * capacity).select("key", "size")
    left = loose.count()
    again = max(1, round(left / block))
    second = _islands(loose.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(again))), capacity, block, islands, 1, seed + 7)
    name = lambda n: F.concat_ws("-", F.lit(n), F.col("block").cast("string"), F.col("bin").cast("string")).alias("container")
    placed = first.where(F.col("free") <= (1 - FULL) * capacity).select("key", name("a")).unionByName(second.select("key", name("b")))
    packed = items.join(placed, "key").select("doc_id", "part", F.col("size").alias("tokens"), "container")
    none = pieces.where("size = 0 and part = 0").select("doc_id", "part", F.lit(0).alias("tokens"), F.lit(None).cast("string").alias("container"))
    return packed.unionByName(whole).unionByName(none)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least number of containers that could hold them, and the share of space used."""
    used = packed.where("container is not null")
    return used.agg(F.countDistinct("container").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).select(
        "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"),
        F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity)).otherwise(1.0).alias("fill"),
    )
