"""Language-model scoring with a hierarchical Pitman-Yor trigram model.

The two words before a token are a context with a restaurant of its own. Its customers
are the words seen after them, and its tables send customers to the restaurant of the
last of the two words, which all contexts that end in this word share as their parent.
The tables there send customers to the root that these restaurants share in turn, whose
base is uniform over the training words and one word more for all others. A word's
probability in a restaurant is

    (c - d t + (theta + d T) p(word)) / (theta + C)

with its customers c and tables t there, all customers C and tables T, and ``p`` by the
same formula from the parent.

Gibbs sampling draws every dish's number of tables, arrangements summed out. Given an
auxiliary variable ``y ~ Gamma(theta / d + T)`` for each restaurant, its dishes are
independent of each other, ``P(t) ~ S_d(c, t) (d y p)^t`` (``seating.py``), with the dish's own
tables taken out of ``p``; so all dishes of a level are drawn together, wherever they lie,
trigram restaurants first, then their parents, then the root. Draws are keyed by context, word and
step: scores don't depend on how the corpus is dealt out, but for rounding of sums. A
text's probability averages each token's over ``samples`` states after ``burn_in``; its
``perplexity`` follows.

How it spreads. A token (context of two words, word; 64-bit hashes) is dealt to a *cell* by the last
context word; if that word has more than a cell's share, a number of parts by the
predicted word. How many is read from a table of counts of 65,536 hash buckets of
context words, the only thing collected that looks at frequencies, and of fixed size. A few cells make a
*bundle*, the unit that travels and is worked through cell by cell.

1. Tasks count distinct (context, word) in packs of texts, one body for each bundle met;
   bundles add them up and keep what sampling needs (dishes with two customers or more).
2. Rounds: bundles draw their tables; sums by word, and by context where a context is
   split over cells, go to *parts* (hash ranges), which add them up, draw the root's
   tables and send back what each bundle asked for, as lists in the order of its keys.
3. Texts are dealt once more, now with the place of every token; bundles add up each
   document's scores, which meet by pack.

Each step is written to the shared scratch folder. The driver sees three totals of the root per round.

All statistics cover all training documents. Null and empty texts are the end token
alone. A null id counts as held out. Repeated rows are scored each on its own, so ties
need no rule; one very long text forms a pack of its own. Without training rows every
known count is 0 and probabilities fall to the base. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermalis.llm.arrowio import give_back, map_columns, slices
from thermalis.llm.scratch import Scratch
from thermalis.llm.seating import draw_tables, gamma
from thermalis.llm.words import mix, words

BEGIN, END = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xA24BAED4963EE407)
#: Text bytes per cell, cells in a bundle, and text bytes per packed group of tokens inside a task.
CELL_BYTES, CELLS, PACK_BYTES = 4 << 20, 4, 18 << 20
#: Hash buckets of context words whose sizes decide into how many parts a context is dealt.
BUCKETS = 1 << 16
#: Bits of a pack's number that count packs inside a task.
PACK_BITS = 20
#: Bundles for each part, at most twice as many, once there are so many parts (as a power of two); below, up to four parts a bundle.
#: Each bundle sends a body to each part, so their number grows with the square of the bundles, divided by this.
BUNDLES_A_PART, LEAST_PART_BITS = 8, 6
#: Bytes up to which arrays count as small, and how an Arrow stream begins (a small body's length never does).
SMALL, STREAM = 1 << 16, b"\xff\xff\xff\xff"
#: Kinds of rows: asked by word, asked by context, statistics of a bundle, its tables, packed tokens, documents of a pack,
#: and where a bundle's words and contexts stand among those it asked for.
WORD, CONTEXT, STATISTICS, TABLES, TOKENS, DOCUMENTS, PLACES = range(7)
ROWS = "kind int, bundle long, part int, sample int, keys array<long>, body binary, cells array<binary>"


def fit(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def to_body(**arrays: np.ndarray) -> bytes:
    """Arrays of any lengths as one compressed Arrow stream: a record with a list for each.

    Whole numbers of 16 bits or more are two lists, of their low bytes and of the rest, which pack better. Small arrays, for
    which a stream would cost more than they hold, are one compressed block: its length, names, kinds and lengths, then the
    arrays, each from a multiple of eight bytes on.
    """
    split = {}
    for k, a in arrays.items():
        if a.dtype.kind == "u" and a.dtype.itemsize > 1:
            split[k + "/low"], split[k + "/rest"] = (a & a.dtype.type(255)).astype(np.uint8), fit(a >> a.dtype.type(8))
        else:
            split[k] = a
    if sum(a.nbytes for a in split.values()) <= SMALL:
        parts = [";".join(f"{k}:{a.dtype.str}:{len(a)}" for k, a in split.items()).encode() + b"\n", *(a.tobytes() for a in split.values())]
        raw = b"".join(x + bytes(-len(x) % 8) for x in parts)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)
    lists = {k: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a)) for k, a in split.items()}
    batch, sink = pa.record_batch(lists), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _small_arrays(body: pa.Buffer) -> dict[str, np.ndarray]:
    raw = pa.decompress(body.slice(8), int.from_bytes(body.slice(0, 8).to_pybytes(), "little"), "zstd", asbytes=True)
    end = raw.index(b"\n")
    found, at = {}, end + 1
    for field in raw[:end].decode().split(";") if end else ():
        name, kind, n = field.split(":")
        at += -at % 8
        found[name] = np.frombuffer(raw, kind, int(n), at) if int(n) else np.zeros(0, kind)
        at += found[name].nbytes
    return found


def from_body(body) -> dict[str, np.ndarray]:
    body = pa.py_buffer(body)
    if body.slice(0, 4).to_pybytes() != STREAM:
        found = _small_arrays(body)
    else:
        with pa.ipc.open_stream(body, options=pa.ipc.IpcReadOptions(use_threads=False)) as stream:
            batch = stream.read_next_batch()
        found = {k: batch.column(k).values.to_numpy(zero_copy_only=False) for k in batch.schema.names}
    for k in [k.removesuffix("/low") for k in found if k.endswith("/low")]:
        low, rest = found.pop(k + "/low"), found.pop(k + "/rest")
        wide = np.dtype(f"u{min(8, 2 * rest.dtype.itemsize)}")
        found[k] = rest.astype(wide) << wide.type(8) | low
    return found


def word_arrays(hashes: np.ndarray) -> dict[str, np.ndarray]:
    """Ascending hashes as differences, whose low 48 bits pack no further and whose high ones are mostly zero."""
    step = np.diff(hashes, prepend=np.uint64(0))
    return {"low": step.astype("<u4").view(np.int32), "middle": (step >> np.uint64(32)).astype("<u2").view(np.int16), "high": fit(step >> np.uint64(48))}


def word_hashes(body: dict[str, np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(body["low"].view("<u4").astype(np.uint64) | body["middle"].view("<u2").astype(np.uint64) << np.uint64(32) | body["high"].astype(np.uint64) << np.uint64(48), dtype=np.uint64)


def bits_of_parts(bundles: int) -> int:
    """How many leading bits of a key name its part."""
    bits = (bundles - 1).bit_length()
    return max(min(bits + 1, LEAST_PART_BITS), min(16, bits - BUNDLES_A_PART.bit_length() + 1), 1)


def freed(work):
    """``work`` on a group's table; what it leaves unused goes back before the next group."""

    def run(t: pa.Table) -> pa.Table:
        out = work(t)
        give_back()
        return out

    return run


def keyed(columns: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """One integer for each row of ``columns`` (numbers below ``sizes``), in their order."""
    key, size = columns[0].astype(np.int64), sizes[0]
    for c, n in zip(columns[1:], sizes[1:], strict=True):
        if size * n >= 1 << 62:
            distinct, key = np.unique(key, return_inverse=True)
            size = len(distinct)
        key, size = key * n + c, size * n
    return key


def runs(b: np.ndarray) -> np.ndarray:
    """Where entries of another last context word begin."""
    return np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))


def context_hash(b: np.ndarray, a: np.ndarray | None = None) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(b + np.uint64(0x51ED270B)) if a is None else mix(mix(a + np.uint64(0x2545F491)) + b)


class Cell:
    """Distinct (context, word) of one cell, each with its training count, in order of hashes."""

    def __init__(self, vocabulary: np.ndarray, b, a, w, count):
        n = len(vocabulary)
        key = keyed([b, a, w], [n, n, n])
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.place = np.empty(len(key), np.int32)  # of each given row among the distinct ones
        self.place[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(key))))
        at = order[first]
        self.b, self.a, self.w = b[at], a[at], w[at]
        self.c = np.add.reduceat(count[order], first)
        new = np.concatenate([[True], (self.b[1:] != self.b[:-1]) | (self.a[1:] != self.a[:-1])])
        self.context = np.cumsum(new) - 1
        self.context_b, self.context_a = self.b[new], self.a[new]
        pairs, self.pair = np.unique(self.b * np.int64(n) + self.w, return_inverse=True)
        pair_b, self.pair_word = pairs // n, pairs % n
        self.parents, self.pair_parent = np.unique(pair_b, return_inverse=True)
        self.context_parent = np.searchsorted(self.parents, self.context_b)
        self.pair_total = np.bincount(self.pair, self.c, len(pairs)).astype(np.int64)
        self.many, self.many_pairs = np.flatnonzero(self.c > 1), np.flatnonzero(self.pair_total > 1)

    def customers(self) -> np.ndarray:
        return np.bincount(self.context, self.c, len(self.context_b)).astype(np.int64)

    def statistics(self) -> dict[str, np.ndarray]:
        """What sampling needs: dishes of two customers or more, and the sums of all others."""
        contexts, context3 = np.unique(self.context[self.many], return_inverse=True)
        place = np.full(len(self.pair_total), -1)
        place[self.many_pairs] = np.arange(len(self.many_pairs))
        single = self.c == 1
        lone = self.pair_total == 1
        return {
            "c3": fit(self.c[self.many]),
            "context3": fit(context3),
            "pair3": fit(place[self.pair[self.many]]),
            "a": fit(self.context_a[contexts]),
            "parent_of": fit(self.context_parent[contexts]),
            "singles": fit(np.bincount(self.context[single], minlength=len(self.context_b))[contexts]),
            "word": fit(self.pair_word[self.many_pairs]),
            "parent2": fit(self.pair_parent[self.many_pairs]),
            "singles2": fit(np.bincount(self.pair[single], minlength=len(self.pair_total))[self.many_pairs]),
            "b": fit(self.parents),
            "lone": fit(np.bincount(self.pair_parent[lone], minlength=len(self.parents))),
        }


def tables_of(n_contexts: int, s: dict, t3: np.ndarray, t2: np.ndarray):
    """(customers of pairs, customers and tables of parents, tables of contexts) by a cell's statistics and tables."""
    c2 = s["singles2"] + np.bincount(s["pair3"], t3, len(s["word"])).astype(np.int64)
    base = s["lone"].astype(np.int64)
    c1 = base + np.bincount(s["parent2"], c2, len(base)).astype(np.int64)
    t1 = base + np.bincount(s["parent2"], t2, len(base)).astype(np.int64)
    return c2, c1, t1, s["singles"] + np.bincount(s["context3"], t3, n_contexts).astype(np.int64)


class Known:
    """What a bundle got back, in the order of its keys: by word (count, customers, tables in the root), by split context (customers, parents' customers, tables)."""

    def __init__(self, rows: pa.Table):
        got = {WORD: [], CONTEXT: []}
        for kind, _, body in sorted(zip(*(rows.column(c).to_pylist() for c in ("kind", "part")), rows.column("body"), strict=True), key=lambda r: r[:2]):
            got[kind].append(from_body(body.as_buffer()))
        self.words, self.contexts = (tuple(np.concatenate([v[c] for v in got[kind]]) if got[kind] else np.zeros(0, np.int64) for c in "xyz") for kind in (WORD, CONTEXT))


def found_in(keys: np.ndarray, wanted: np.ndarray):
    """(which of ``wanted`` are among the ascending ``keys``, where)."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    on = np.flatnonzero(keys[at] == wanted)
    return on, at[on]


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [c[i].values.to_numpy() if c[i].is_valid else None for c in column.chunks for i in range(len(c))]


def root_probability(customers: np.ndarray, tables: np.ndarray, all_customers, all_tables: int, base: float, theta: float, d: float) -> np.ndarray:
    return (customers - d * tables + (theta + d * all_tables) * base) / (theta + all_customers)


def score_texts(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", theta: float = 1.0, d: float = 0.8, root_theta: float = 1.0, root_d: float = 0.5, burn_in: int = 1, samples: int = 3, bundles: int | None = None) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity.

    ``training`` says which rows the model learns from (null: not). ``base_score`` is the
    unigram score with 0.5 added to every count. ``bundles`` changes the work's cut, never a score.
    """
    spark, scratch, fields = df.sparkSession, Scratch(df.sparkSession), [f.split(" ")[0] for f in ROWS.split(", ")]
    rows = df.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))

    def sizes(batches):
        found, size = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                h, o = words(part.column("text"))
                found += np.bincount((mix(h) >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
                found[int(mix(np.array([BEGIN]))[0] >> np.uint64(48))] += part.num_rows
                size += part.column("text").nbytes
        at = np.flatnonzero(found)
        yield pa.array(np.append(at, -1)), [np.append(found[at], size)]

    measured = {r["bucket"]: r["n"] for r in map_columns(rows, "bucket long, n long", sizes).groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    bundles = bundles or max(2, -(-measured.pop(-1, 0) // (CELLS * CELL_BYTES)))
    measured.pop(-1, None)
    n_cells, bucket = bundles * CELLS, np.zeros(BUCKETS)
    bucket[list(measured)] = list(measured.values())
    sent = spark.sparkContext.broadcast(np.maximum(1, np.ceil(bucket * n_cells / max(1.0, bucket.sum()))).astype(np.uint64))
    part_bits = bits_of_parts(bundles)

    def splits(b: np.ndarray) -> np.ndarray:
        return sent.value[(mix(b) >> np.uint64(48)).astype(np.int64)]

    def deal(hashes: list[np.ndarray], train: list[bool], scoring: bool):
        """(bundle, body) of a pack's tokens: distinct (context, word) by cell with training counts or, for scoring, with their rows."""
        many = np.array([len(x) + 1 for x in hashes])
        ends, w = np.cumsum(many), np.concatenate([y for x in hashes for y in (x, [END])])
        b, a = np.empty_like(w), np.empty_like(w)
        b[1:] = w[:-1]
        b[ends - many] = BEGIN
        a[1:] = b[:-1]
        a[ends - many] = BEGIN
        with np.errstate(over="ignore"):
            cell = fit(mix(b + mix(w) % splits(b)) % np.uint64(n_cells))
        order = np.argsort(cell, kind="stable").astype(np.int32)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=n_cells))])
        row = np.repeat(np.arange(len(hashes), dtype=np.int32), many)
        learns = np.array(train, bool)
        for k in np.unique(np.flatnonzero(np.diff(cuts)) // CELLS).tolist():
            at = order[cuts[k * CELLS] : cuts[(k + 1) * CELLS]]
            vocabulary, place = np.unique(np.concatenate([b[at], a[at], w[at]]), return_inverse=True)
            ib, ia, iw = place[: len(at)], place[len(at) : 2 * len(at)], place[2 * len(at) :]
            cells, mine = [], cell[at] - k * CELLS
            for j in range(CELLS):
                on = np.flatnonzero(mine == j)
                key = keyed([ib[on], ia[on], iw[on]], [len(vocabulary)] * 3)
                own = np.argsort(key, kind="stable")
                key = key[own]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else own
                entry, owner = on[own[first]], row[at[on[own]]]
                starts, ahead = runs(ib[entry]) if len(entry) else entry, np.diff(ia[entry], prepend=0)
                ahead[starts] = ia[entry[starts]]  # first words of contexts ascend while the last one is the same
                counts = {"count": fit(np.add.reduceat(learns[owner].astype(np.int64), first) if len(first) else first)}
                if scoring:
                    counts |= {"many": fit(np.diff(np.append(first, len(own)))), "row": fit(owner)}
                cells.append(to_body(b=fit(ib[entry]), a=fit(ahead), w=fit(iw[entry]), **counts) if len(entry) else None)
            yield k, to_body(**word_arrays(vocabulary), documents=np.array([len(hashes)])), cells

    def packs(scoring: bool):
        def run(batches):
            part, number, hashes, train, ids, size = TaskContext.get().partitionId(), 0, [], [], [], 0

            def close():
                name = (part << PACK_BITS) + number
                got = list(deal(hashes, train, scoring))
                if scoring:
                    held = np.array([not t for t in train])
                    known_id = np.array([i is not None for i in ids])
                    got.append((-1 - name % bundles, to_body(known_id=known_id, id=np.array([i or 0 for i in ids], np.int64), held=held, n=np.array([len(h) + 1 for h in hashes])), None))
                kinds = [TOKENS if k >= 0 else DOCUMENTS for k, _, _ in got]
                return pa.array(kinds, pa.int32()), [[k for k, _, _ in got], [0] * len(got), [0] * len(got), [[name]] * len(got), pa.array([x for _, x, _ in got], pa.binary()), pa.array([c for _, _, c in got], pa.list_(pa.binary()))]

            for batch in batches:
                for piece in slices(batch, "text"):
                    h, o = words(piece.column("text"))
                    hashes += np.split(h, o[1:-1])
                    train += piece.column("train").to_pylist()
                    ids += piece.column("doc").to_pylist()
                    size += piece.column("text").nbytes + 4 * piece.num_rows
                    if size > PACK_BYTES:
                        yield close()
                        number, hashes, train, ids, size = number + 1, [], [], [], 0
            if hashes:
                yield close()

        return map_columns(rows, ROWS, run)

    class Bundle:
        """Bodies of a bundle's packs over one list of words."""

        def __init__(self, t: pa.Table):
            at = np.flatnonzero(t.column("kind").to_numpy() == TOKENS)
            names = np.array([t.column("keys")[int(i)].values[0].as_py() for i in at], np.int64)
            order = np.argsort(names, kind="stable")
            self.names, self.at, self.bodies = names[order], at[order].tolist(), t.column("cells")
            heads = [from_body(t.column("body")[i].as_buffer()) for i in self.at]
            self.documents = [int(h["documents"][0]) for h in heads]
            self.words, place = np.unique(np.concatenate([word_hashes(h) for h in heads]), return_inverse=True)
            self.place = np.split(place.astype(np.int32), np.cumsum([len(h["low"]) for h in heads])[:-1])

        def cells(self):
            """(number, entries by number of pack, cell) of each cell that has any; one is unpacked at a time."""
            for k in range(CELLS):
                found = ((i, self.bodies[at].values[k]) for i, at in enumerate(self.at))
                packs = {i: from_body(c.as_buffer()) for i, c in found if c.is_valid}
                if packs:
                    for i, p in packs.items():
                        starts, a = runs(p["b"]), np.cumsum(p["a"].astype(np.int64))
                        p["a"] = a - np.repeat(a[starts] - p["a"][starts], np.diff(np.append(starts, len(a))))
                        for c in "baw":
                            p[c] = self.place[i][p[c]]
                    b, a, w, count = (np.concatenate([p[c] for p in packs.values()]).astype(np.int64) for c in ("b", "a", "w", "count"))
                    yield k, packs, Cell(self.words, b, a, w, count)

    def split_contexts(cell: Cell, vocabulary: np.ndarray):
        """(hashes of contexts dealt to several cells: parents, then contexts; which these are)."""
        parents = np.flatnonzero(splits(vocabulary[cell.parents]) > 1)
        contexts = np.flatnonzero(np.isin(cell.context_parent, parents))
        return context_hash(vocabulary[cell.parents[parents]]), context_hash(vocabulary[cell.context_b[contexts]], vocabulary[cell.context_a[contexts]]), parents, contexts

    def asked(found) -> list[tuple]:
        """(kind, part, keys, body) by part, from (kind, ascending keys, values aligned with them)."""
        out = []
        for kind, keys, x, y, z in found:
            edges = np.searchsorted(keys >> np.uint64(64 - part_bits), np.arange((1 << part_bits) + 1, dtype=np.uint64))
            for p in np.flatnonzero(np.diff(edges)).tolist():
                cut = slice(edges[p], edges[p + 1])
                out.append((kind, p, keys[cut].view(np.int64), to_body(x=fit(x[cut]), y=fit(y[cut]), z=fit(z[cut]))))
        return out

    def table(found: list[tuple], bundle: list[int] | int, sample: int = 0) -> pa.Table:
        n, cols = len(found), list(zip(*found, strict=True)) or [()] * 4
        kinds = ((pa.int32(), cols[0]), (pa.int64(), bundle if isinstance(bundle, list) else [bundle] * n), (pa.int32(), cols[1]), (pa.int32(), [sample] * n), (pa.list_(pa.int64()), cols[2]), (pa.binary(), cols[3]))
        return pa.table([*(pa.array(list(v), k) for k, v in kinds), pa.nulls(n, pa.list_(pa.binary()))], names=fields)

    def summed(keys: list[np.ndarray], *columns: list[np.ndarray]):
        """Ascending distinct keys with sums of the columns."""
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        return k, *(np.bincount(at, np.concatenate(c), len(k)).astype(np.int64) for c in columns)

    none = np.zeros(0, np.uint64)

    def count_up(t: pa.Table) -> pa.Table:
        """A bundle's statistics, what it asks for, and its first tables: one for each dish."""
        number, bundle = t.column("bundle")[0].as_py(), Bundle(t)
        word, count, tables, keys, customers, parents_c, context_t, numbers, kept = [], [], [], [none], [none], [none], [none], [], {}
        for k, _, cell in bundle.cells():
            has = (cell.pair_total > 0).astype(np.int64)
            word.append(bundle.words[cell.pair_word])
            count.append(cell.pair_total)
            tables.append(has)
            up, own, parents, contexts = split_contexts(cell, bundle.words)
            c1 = np.bincount(cell.pair_parent, np.bincount(cell.pair, cell.c > 0, len(has)), len(cell.parents))
            keys += [up, own]
            numbers.append(k)
            customers += [np.zeros(len(up)), cell.customers()[contexts]]
            parents_c += [c1[parents], np.zeros(len(own))]
            context_t += [np.bincount(cell.pair_parent, has, len(cell.parents))[parents], np.bincount(cell.context, cell.c > 0, len(cell.context_b))[contexts]]
            kept |= {f"{name}_{k}": v for name, v in cell.statistics().items()}
        word, count, tables = summed(word, count, tables)
        split = summed(keys, customers, parents_c, context_t)
        places = {"asked": np.packbits(np.isin(bundle.words, word))}
        for i, k in enumerate(numbers):
            places |= {f"parents_{k}": fit(np.searchsorted(split[0], keys[1 + 2 * i])), f"contexts_{k}": fit(np.searchsorted(split[0], keys[2 + 2 * i]))}
        return table([(PLACES, -1, None, to_body(**places)), *asked([(WORD, word, count, tables, np.zeros_like(tables)), (CONTEXT, *split)]), (STATISTICS, -1, None, to_body(**word_arrays(bundle.words), **kept))], number)

    def add_up(t: pa.Table, alpha: float, step: int, base: float) -> pa.Table:
        """A part's sums by key, the root's tables by word, and for each bundle what it asked for."""
        kinds, bundle, keys_, bodies = t.column("kind").to_pylist(), t.column("bundle").to_pylist(), _lists(t.column("keys")), t.column("body")
        out, owners, total = [], [], np.zeros(4, np.int64)
        part = t.column("part")[0].as_py()
        for kind in (WORD, CONTEXT):
            asks = {b: i for i, (k, b) in enumerate(zip(kinds, bundle, strict=True)) if k == kind and keys_[i] is not None}
            last = {b: i for i, (k, b) in enumerate(zip(kinds, bundle, strict=True)) if k == kind and keys_[i] is None} or asks
            order = sorted(asks)
            if not order:
                continue
            keys, at = np.unique(np.concatenate([keys_[asks[b]] for b in order]).view(np.uint64), return_inverse=True)
            first, now = ([from_body(bodies[which[b]].as_buffer()) for b in order] for which in (asks, last))
            add = lambda c, found, at=at, n=len(keys): np.bincount(at, np.concatenate([f[c] for f in found]), n).astype(np.int64)
            x, y = add("x", first), add("y", now)
            if kind == WORD:
                z = draw_tables(y, np.full(len(y), alpha * base), keys, step, root_d)
                total += [(x > 0).sum(), x.sum(), y.sum(), z.sum()]
            else:
                z = add("z", now)
            for b, own in zip(order, np.split(at, np.cumsum([len(f["x"]) for f in first])[:-1]), strict=True):
                out.append((kind, part, None, to_body(x=fit(x[own]), y=fit(y[own]), z=fit(z[own]))))
                owners.append(b)
        return table([*out, (STATISTICS, part, total, None)], [*owners, -1], step)

    def asks_of(t: pa.Table) -> list[tuple]:
        """(kind, part, keys, body) of a bundle, in the order of its keys."""
        asks = t.filter(pa.compute.and_(pa.compute.is_valid(t.column("keys")), pa.compute.less(t.column("kind"), STATISTICS)))
        return sorted(zip(asks.column("kind").to_pylist(), asks.column("part").to_pylist(), (k.view(np.uint64) for k in _lists(asks.column("keys"))), asks.column("body"), strict=True), key=lambda r: r[:2])

    def replies(t: pa.Table, sample: int) -> pa.Table:
        return t.filter(pa.compute.and_(pa.compute.and_(pa.compute.is_null(t.column("keys")), pa.compute.equal(t.column("sample"), sample)), pa.compute.less(t.column("kind"), STATISTICS)))

    def body_of(t: pa.Table, kind: int, sample: int | None = None) -> dict | None:
        on = pa.compute.equal(t.column("kind"), kind)
        if sample is not None:
            on = pa.compute.and_(on, pa.compute.equal(t.column("sample"), sample))
        found = t.filter(on).column("body")
        return from_body(found[0].as_buffer()) if len(found) else None

    def sample_tables(t: pa.Table, step: int, root: tuple) -> pa.Table:
        """One Gibbs sweep over a bundle's dishes: contexts of two words, then their parents."""
        number = t.column("bundle")[0].as_py()
        statistics, state, asks = body_of(t, STATISTICS), body_of(t, TABLES), asks_of(t)
        known = Known(replies(t, step - 1))
        word_keys, context_keys = (np.concatenate([none, *(a[2] for a in asks if a[0] == kind)]) for kind in (WORD, CONTEXT))
        v, _, root_c, root_t = root
        word, tables, context, more_c, more_t, kept = [], [], [none], [none], [none], {}
        vocabulary = word_hashes(statistics)
        for k in range(CELLS):
            if f"c3_{k}" not in statistics:
                continue
            s = {name.rsplit("_", 1)[0]: x for name, x in statistics.items() if name.endswith(f"_{k}")}
            for name in ("c3", "context3", "pair3", "a", "parent_of", "word", "parent2", "b"):
                s[name] = s[name].astype(np.int64)
            t3 = state[f"t3_{k}"].astype(np.int64) if state else np.ones(len(s["c3"]), np.int64)
            t2 = state[f"t2_{k}"].astype(np.int64) if state else np.ones(len(s["word"]), np.int64)
            c2, c1, t1, t3_sum = tables_of(len(s["a"]), s, t3, t2)
            parent_key = context_hash(vocabulary[s["b"]])
            context_key = context_hash(vocabulary[s["b"][s["parent_of"]]], vocabulary[s["a"]])
            on, at = found_in(context_keys, parent_key)
            c1[on], t1[on] = known.contexts[1][at], known.contexts[2][at]
            over, at = found_in(context_keys, context_key)
            t3_sum[over] = known.contexts[2][at]
            # the root without each pair's own tables
            at = np.searchsorted(word_keys, vocabulary[s["word"]])
            rest = known.words[1][at] - t2
            p1 = root_probability(rest, np.minimum(known.words[2][at], rest), root_c - t2, root_t, 1 / (v + 1), root_theta, root_d)
            # the parent without each dish's own tables
            pair, parent = s["pair3"], s["parent2"][s["pair3"]]
            rest = c2[pair] - t3
            lost = t2[pair] - np.minimum(t2[pair], rest)
            p2 = (rest - d * (t2[pair] - lost) + (theta + d * (t1[parent] - lost)) * p1[pair]) / (theta + c1[parent] - t3)
            pair_key = mix(parent_key[s["parent2"]] ^ mix(vocabulary[s["word"]]))
            y = gamma(theta / d + t3_sum, context_key, 2 * step)
            key3 = mix(context_key[s["context3"]] ^ mix(vocabulary[s["word"][pair]]))
            t3 = draw_tables(s["c3"], d * y[s["context3"]] * p2, key3, 2 * step, d)
            y = gamma(theta / d + t1, parent_key, 2 * step + 1)
            c2 = s["singles2"] + np.bincount(pair, t3, len(s["word"])).astype(np.int64)
            t2 = draw_tables(c2, d * y[s["parent2"]] * p1, pair_key, 2 * step + 1, d)
            # what the dishes drawn have beyond the one table each that they began with
            word.append(vocabulary[s["word"]])
            tables.append(t2 - 1)
            more = lambda at, v, n: np.bincount(at, v, n)
            context += [parent_key[on], context_key[over]]
            more_c += [more(s["parent2"], np.bincount(pair, t3 - 1, len(t2)), len(s["b"]))[on], np.zeros(len(over))]
            more_t += [more(s["parent2"], t2 - 1, len(s["b"]))[on], more(s["context3"], t3 - 1, len(s["a"]))[over]]
            kept |= {f"t3_{k}": fit(t3), f"t2_{k}": fit(t2)}
        beyond = {WORD: summed(word or [none], tables or [none]), CONTEXT: summed(context, more_c, more_t)}
        out = []
        for kind, part, own, body in asks:
            first, (changed, *by) = from_body(body.as_buffer()), beyond[kind]
            values = [first["y"].astype(np.int64), first["z"].astype(np.int64)]
            on, at = found_in(changed, own)
            for v, b in zip(values, by, strict=False):
                v[on] += b[at]
            out.append((kind, part, None, to_body(y=fit(values[0]), z=fit(values[1]))))
        return table([*out, (TABLES, -1, None, to_body(**kept))], number, step)

    counted = scratch.save(packs(False).groupBy("bundle").applyInArrow(freed(count_up), ROWS), "zstd")
    asks, statistics = counted.where(f"kind < {STATISTICS}"), counted.where(f"kind = {STATISTICS}")

    def to_parts(up: DataFrame | None, step: int, root: tuple) -> tuple[DataFrame, tuple]:
        """Add up by part; the root's totals (words, training tokens, customers, tables)."""
        v, _, _, tables = root
        rng = np.random.default_rng(step)
        alpha = root_d * rng.gamma(root_theta / root_d + tables)
        both = asks if up is None else asks.unionByName(up.where(f"kind < {STATISTICS}"))
        down = scratch.save(both.groupBy("part").applyInArrow(freed(lambda t: add_up(t, alpha, step, 1 / (v + 1))), ROWS), "zstd")
        got = down.where(f"kind = {STATISTICS}").select(*(F.sum(F.get("keys", F.lit(i))).alias(f"s{i}") for i in range(4))).first()
        return down.where(f"kind < {STATISTICS}"), tuple(int(got[i] or 0) for i in range(4))

    def draw(step: int, root: tuple):
        return freed(lambda t: sample_tables(t, step, root))

    words_asked = asks.where(f"kind = {WORD}").agg(F.sum(F.size("keys"))).first()[0] or 0
    down, root = to_parts(None, 0, (words_asked, 0, 0, words_asked))
    states, roots, before = [], [], None
    for step in range(1, burn_in + samples + 1):
        given = asks.unionByName(statistics).unionByName(down)
        given = given if before is None else given.unionByName(before)
        drawn = scratch.save(given.groupBy("bundle").applyInArrow(draw(step, root), ROWS), "zstd")
        before = drawn.where(f"kind = {TABLES}")
        down, root = to_parts(drawn, step, root)
        if step > burn_in:
            states += [before, down]
            roots.append((step, root))

    def score(t: pa.Table) -> pa.Table:
        """A bundle's sums for each document, as one row for each pack."""
        names, bodies, held = [], [], t.column("bundle")[0].as_py() < 0
        if held:
            names, bodies = [k[0] for k in _lists(t.column("keys"))], t.column("body").to_pylist()
        elif pa.compute.any(pa.compute.equal(t.column("kind"), TOKENS)).as_py():
            bundle, places = Bundle(t), body_of(t, PLACES)
            asked_words = np.cumsum(np.unpackbits(places.pop("asked"), count=len(bundle.words)), dtype=np.int32) - 1
            found = [np.zeros((4, n)) for n in bundle.documents]
            known = [(Known(replies(t, step)), body_of(t, TABLES, step), root) for step, root in roots]
            for k, packs, cell in bundle.cells():
                values, base = probabilities(cell, bundle.words, k, known, asked_words, places), 0
                for i, p in packs.items():
                    place = np.repeat(cell.place[base : base + len(p["w"])], p["many"])
                    base += len(p["w"])
                    for j, v in enumerate([*values, np.ones(len(cell.c))]):
                        found[i][j] += np.bincount(p["row"], v[place], found[i].shape[1])
            for name, (known_words, base, own, many) in zip(bundle.names.tolist(), found, strict=True):
                on = np.flatnonzero(many)
                names.append(name)
                bodies.append(to_body(row=fit(np.diff(on, prepend=0)), known=fit(np.rint(known_words[on]).astype(np.int64)), base=base[on], own=own[on]))
        return pa.table({"pack": pa.array(names, pa.int64()), "documents": pa.array([held] * len(names), pa.bool_()), "body": pa.array(bodies, pa.binary())})

    def probabilities(cell: Cell, vocabulary: np.ndarray, k: int, known: list, asked_words: np.ndarray, places: dict):
        """By distinct (context, word): whether the word is known, log10 of its base probability and of the model's."""
        customers, mean, word = cell.customers(), 0.0, asked_words[cell.pair_word]
        parents = np.flatnonzero(splits(vocabulary[cell.parents]) > 1)
        contexts = np.flatnonzero(np.isin(cell.context_parent, parents))
        parents_at, contexts_at = places[f"parents_{k}"], places[f"contexts_{k}"]
        for got, state, (v, n, root_c, root_t) in known:
            t3, t2 = np.minimum(cell.c, 1), np.minimum(cell.pair_total, 1)
            t3[cell.many], t2[cell.many_pairs] = state[f"t3_{k}"], state[f"t2_{k}"]
            c2 = np.bincount(cell.pair, t3, len(t2))
            c1, t1 = np.bincount(cell.pair_parent, c2, len(cell.parents)), np.bincount(cell.pair_parent, t2, len(cell.parents))
            t3_sum = np.bincount(cell.context, t3, len(customers))
            c1[parents], t1[parents] = got.contexts[1][parents_at], got.contexts[2][parents_at]
            customers[contexts], t3_sum[contexts] = got.contexts[0][contexts_at], got.contexts[2][contexts_at]
            p1 = root_probability(got.words[1][word], got.words[2][word], root_c, root_t, 1 / (v + 1), root_theta, root_d)
            p2 = (c2 - d * t2 + (theta + d * t1[cell.pair_parent]) * p1) / (theta + c1[cell.pair_parent])
            mean = mean + (cell.c - d * t3 + (theta + d * t3_sum[cell.context]) * p2[cell.pair]) / (theta + customers[cell.context])
            count = got.words[0][word]
        return (count > 0).astype(float)[cell.pair], np.log10((count + 0.5) / (n + 0.5 * (v + 1)))[cell.pair], np.log10(mean / len(known))

    train_tokens = root[1]

    def documents(t: pa.Table) -> pa.Table:
        """Documents of one pack with their sums over all bundles."""
        bodies = {True: [], False: []}
        for on, body in zip(t.column("documents").to_pylist(), t.column("body"), strict=True):
            bodies[on].append(body.as_buffer())
        docs = from_body(bodies[True][0])
        sums = np.zeros((3, len(docs["n"])))
        for body in bodies[False]:
            found = from_body(body)
            row = np.cumsum(found["row"], dtype=np.int64)
            for i, c in enumerate(("known", "base", "own")):
                sums[i, row] += found[c]
        n = docs["n"]
        return pa.table(
            {
                id_col: pa.array(docs["id"], pa.int64(), mask=~docs["known_id"].astype(bool)),
                "held_out": docs["held"].astype(bool),
                "n_tokens": n,
                "n_known": np.rint(sums[0]).astype(np.int64),
                "train_tokens": np.full(len(n), train_tokens),
                "base_score": sums[1],
                "score": sums[2],
                "perplexity": 10 ** np.minimum(300, -sums[2] / n),
            }
        )

    places = scratch.save(counted.where(f"kind = {PLACES}"), "zstd")
    scratch.drop(counted)
    together = packs(True)
    for more in (places, *states):
        together = together.unionByName(more.select(*fields))
    scored = together.groupBy("bundle").applyInArrow(freed(score), "pack long, documents boolean, body binary")
    return scored.groupBy("pack").applyInArrow(freed(documents), f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
