"""Near-duplicate embeddings by spherical-cap filters: random product codes, list decoding, a join on filters, exact verification."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, wide
from .graph import components

#: Filters that a vector exceeds on average, codes that these are spread over, and words of a code's block.
EXCEEDED, CODES, WORDS = 48, 8, 512
#: Leaders that a task holds, rows of a filter that one task compares, members of a stored block.
LEADERS, MOST_ROWS, MEMBERS = 1 << 16, 1 << 15, 512
#: Rows of a bucket that is compared together with others, and rows that are compared at once.
SHORT, HELD = 64, 1 << 16
#: Slack for rounding in angles.
SLACK = 1e-7


class Code:
    """Filter directions for vectors of a width: pairs of random unit words, one for each half of the vector.

    There are several codes, each after a random rotation of its own: how many of a code's filters a
    vector exceeds depends on how its length is dealt to the halves, and over several rotations that evens out.
    """

    def __init__(self, width: int, words: int = WORDS, exceeded: float = EXCEEDED, codes: int = CODES, seed: int = 11):
        rng = np.random.default_rng([seed, width])
        blocks = 1 if width < 8 else 2
        phi = np.linspace(0, np.pi, 1 << 18)
        share = np.cumsum(np.sin(phi) ** max(width - 2, 0))
        share /= share[-1]  # of the sphere within an angle
        # in few dimensions caps are kept at 35 degrees or more, by fewer filters
        n = min(float(words) ** 2, exceeded / codes / share[np.searchsorted(phi, math.radians(35))])
        self.words = max(2, round(n ** (1 / blocks)))
        angle = phi[min(np.searchsorted(share, min(exceeded / codes / self.words**blocks, 1.0)), len(phi) - 1)]
        self.reach = math.cos(angle) if width > 1 else 0.5
        cuts = [width * i // blocks for i in range(blocks + 1)]
        self.codes = []
        for _ in range(codes):
            turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
            halves = []
            for lo, hi in zip(cuts, cuts[1:]):
                w = rng.normal(size=(self.words, hi - lo))
                w = w / np.linalg.norm(w, axis=1, keepdims=True) if width > 1 else np.resize([[1.0], [-1.0]], (self.words, 1))
                halves.append(turn[:, lo:hi] @ w.T / math.sqrt(blocks))
            self.codes.append(halves)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, filter)`` of all filters that each row exceeds, in order of rows.

        The words of each half are listed as far as the best of the other half can lift them over the
        reach, and only listed ones are combined.
        """
        rows, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(x), 256):
            part = x[at : at + 256]
            for k, halves in enumerate(self.codes):
                left, right = part @ halves[0], part @ halves[1] if len(halves) > 1 else np.zeros((len(part), 1))
                r1, a = np.nonzero(left >= self.reach - right.max(axis=1)[:, None])
                r2, b = np.nonzero(right >= self.reach - left.max(axis=1)[:, None])
                n2 = np.bincount(r2, minlength=len(part))
                begin = np.concatenate([[0], np.cumsum(n2)])[:-1]
                pick = np.repeat(np.arange(len(r1)), n2[r1])
                other = np.arange(len(pick)) - np.repeat(np.cumsum(n2[r1]) - n2[r1], n2[r1]) + begin[r1[pick]]
                r, a, b = r1[pick], a[pick], b[other]
                ok = left[r, a] + right[r, b] >= self.reach
                rows.append(r[ok] + at)
                found.append((k * self.words + a[ok]) * right.shape[1] + b[ok])
        rows, found = np.concatenate(rows), np.concatenate(found)
        order = np.argsort(rows, kind="stable")
        return rows[order], found[order]


@lru_cache(maxsize=8)
def code_of(width: int) -> Code:
    return Code(width)


def by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(places, unit rows)`` of the vectors of each width; null, zero and non-finite ones are in none."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    for width in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == width)
        x = column.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, width)
        most = np.abs(x).max(axis=1)
        ok = np.isfinite(most) & (most > 0)
        x = x[ok] / most[ok, None]
        yield at[ok], x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def units(column: pa.Array) -> list[np.ndarray]:
    out: list = [None] * len(column)
    for at, x in by_width(column):
        for i, v in zip(at.tolist(), x):
            out[i] = v
    return out


def sketch(x: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Rows as 8-bit integers, the number that an integer stands for, and the length of what is lost."""
    unit = (np.abs(x).max(axis=1) / 127).astype(np.float32).astype(np.float64)
    q = np.rint(x / unit[:, None]).astype(np.int8)
    return [r.tobytes() for r in q], unit, np.linalg.norm(x - q * unit[:, None], axis=1)


def angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1, 1))


SKETCHES = "code long, gid long, wide boolean, unit float, lost float, sketch binary, part int, lo int, hi int"


def led(rows: DataFrame, half: float) -> DataFrame:
    """``(row, vec_id, leader, delta, embedding, center, filters)``: each vector meets the leaders of its task in the filters it exceeds.

    The first within ``half`` takes it, else it becomes a leader; so near copies are gathered before
    anything is shuffled. Rows without a direction have no leader. ``center`` is the leader's vector, null for a leader.
    """
    least = math.cos(half) + 1e-12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], list[int]] = defaultdict(list)
        names: list[tuple[int, np.ndarray, object]] = []
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                ids, column = b.column(0).to_pylist(), b.column(2)
                leader, delta, center, filters = ([None] * len(ids) for _ in range(4))
                for places, x in by_width(column):
                    r, f = code_of(x.shape[1]).decode(x)
                    ends = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(x)))])
                    for i, (place, v) in enumerate(zip(places.tolist(), x)):
                        own = f[ends[i] : ends[i + 1]].tolist()
                        filters[place] = own
                        met = sorted({m for c in own for m in known[len(v), c]})
                        cos = np.stack([names[m][1] for m in met]) @ v if met else np.zeros(0)
                        if met and cos.max() >= least:
                            m = met[int(np.argmax(cos >= least))]
                            leader[place], center[place], delta[place] = names[m][0], names[m][2], float(angle(names[m][1] @ v)) + SLACK
                        else:
                            leader[place], delta[place] = ids[place], 0.0
                            for c in own:
                                known[len(v), c].append(len(names))
                            names.append((ids[place], v, column[place].as_py()))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(leader, pa.int64()), pa.array(delta, pa.float64()), column, pa.array(center, column.type), pa.array(filters, pa.list_(pa.int32()))], names=["row", "vec_id", "leader", "delta", "embedding", "center", "filters"])
                if len(names) > LEADERS:
                    known.clear()
                    names.clear()

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, vec_id long, leader long, delta double, embedding {kind}, center {kind}, filters array<int>")


def regrouped(led_rows: DataFrame, half: float) -> DataFrame:
    """``(row, vec_id, gid, delta, embedding, center, filters)``: leaders of different tasks that are near each other make one group.

    The smallest leader that no smaller one is near takes the vectors within ``half`` of it from the
    leaders near it; the rest stay with theirs. Two vectors of a group are thus within twice ``half``.
    """
    leaders = led_rows.where("row = leader").select(F.col("row").alias("gid"), F.lit(0.0).alias("delta"), "embedding", "filters")
    near = materialize(compared(leaders, half, True).groupBy("u").agg(F.min("v").alias("v")), "near-leaders")
    taken = near.join(near.select(F.col("u").alias("v")), "v", "left_anti")
    vectors = led_rows.where("row = leader").select(F.col("row").alias("v"), F.col("embedding").alias("taker"))
    takers = taken.join(vectors, "v").select(F.col("u").alias("leader"), F.col("v").alias("first"), "taker")
    least = math.cos(half) + 1e-12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            first = b.column(at["first"])
            who = np.flatnonzero(np.asarray(first.is_valid()))
            gid, delta, center = b.column(at["leader"]).to_pylist(), b.column(at["delta"]).to_pylist(), b.column(at["center"]).to_pylist()
            x, y = (units(b.column(at[c]).take(pa.array(who))) for c in ("embedding", "taker"))
            for i, v, w in zip(who.tolist(), x, y):
                if len(v) == len(w) and (cos := float(v @ w)) >= least:
                    gid[i], delta[i], center[i] = first[i].as_py(), float(angle(cos)) + SLACK, b.column(at["taker"])[i].as_py()
            kind = b.column(at["embedding"]).type
            yield pa.record_batch([b.column(at["row"]), b.column(at["vec_id"]), pa.array(gid, pa.int64()), pa.array(delta, pa.float64()), b.column(at["embedding"]), pa.array(center, kind), b.column(at["filters"])], names=["row", "vec_id", "gid", "delta", "embedding", "center", "filters"])

    kind = led_rows.schema["embedding"].dataType.simpleString()
    joined = led_rows.where("leader is not null").join(takers, "leader", "left")
    return joined.mapInArrow(run, f"row long, vec_id long, gid long, delta double, embedding {kind}, center {kind}, filters array<int>")


def compared(rows: DataFrame, within: float, smallest: bool) -> DataFrame:
    """``(u, v)``, u > v: groups that may be ``within`` an angle, of those that meet on a filter; with ``smallest`` only each u's smallest v.

    ``rows`` are ``gid, delta, embedding, filters`` and perhaps ``center``: for the filters of a vector its group goes out, as an
    8-bit sketch of its center and the radius that its members may have, once per task. Sketches are compared
    with the error that they are known to have, so nothing within the angle is lost. A filter of more than ``MOST_ROWS`` rows is cut in
    parts, every two of which meet in a task.
    """
    spark = rows.sparkSession
    width = F.size("embedding").cast("long")
    code = lambda f: F.shiftleft(width, 32) + f
    parts = rows.select(F.explode("filters").alias("f"), width.alias("w")).groupBy((F.shiftleft("w", 32) + F.col("f")).alias("code")).count()
    big = parts.where(F.col("count") > MOST_ROWS).select("code", F.ceil(F.col("count") / MOST_ROWS).cast("int").alias("parts"))
    center = F.coalesce("center", "embedding") if "center" in rows.columns else F.col("embedding")
    sent = rows.select("gid", "delta", center.alias("c"), F.transform("filters", code).alias("codes")).mapInArrow(send, "code long, gid long, wide boolean, unit float, lost float, sketch binary")
    dealt = sent.join(big, "code", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"lo": F.least("part", "o"), "hi": F.greatest("part", "o")}).select(*(x.split()[0] for x in SKETCHES.split(", ")))
    keys = ["code", "lo", "hi"]
    return dealt.repartition(wide(spark), *keys).sortWithinPartitions(*keys).mapInArrow(meeting(within, smallest), "u long, v long").distinct()


def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A group's sketch for each filter; a group that this task has sent to a filter before isn't sent again."""
    seen: set[tuple[int, int]] = set()
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            b = whole.slice(at, 1024)
            gids, deltas, codes = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()
            out: list[tuple] = []
            for places, x in by_width(b.column(2)):
                for place, q, unit, lost in zip(places.tolist(), *sketch(x)):
                    gid, alone = gids[place], deltas[place] == 0
                    for c in codes[place]:
                        # a center itself has no radius, other members count with the largest
                        if alone or (c, gid) not in seen:
                            if not alone:
                                seen.add((c, gid))
                            out.append((c, gid, not alone, unit, lost, q))
            if len(seen) > 1 << 20:
                seen.clear()
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.float32(), pa.float32(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=["code", "gid", "wide", "unit", "lost", "sketch"])


def meeting(within: float, smallest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compare the groups of each bucket of sorted rows of ``SKETCHES``: many short buckets at once, a long one in blocks."""
    radius = within / 2

    def close(wide: np.ndarray, unit: np.ndarray, lost: np.ndarray, a, b, dots: np.ndarray) -> np.ndarray:
        """Whether groups may be within the angle, with all that their sketches may be wrong by; ``a`` and ``b`` index so that shapes agree."""
        cos = dots.astype(np.float64) * unit[a] * unit[b] + lost[a] + lost[b] + lost[a] * lost[b] + 1e-5
        return cos >= np.cos(within + radius * wide[a] + radius * wide[b])

    def met(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of all buckets of ``rows``, whose vectors have one width."""
        code, gid, part, lo, hi = (rows[c].to_numpy() for c in ("code", "gid", "part", "lo", "hi"))
        wide, unit, lost = (rows[c].to_numpy().astype(np.float64) for c in ("wide", "unit", "lost"))
        q = np.frombuffer(b"".join(rows["sketch"].to_pylist()), dtype=np.int8).reshape(len(gid), -1)
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)]))
        sizes = np.diff(np.concatenate([begins, [len(gid)]]))
        left = np.repeat(np.where(sizes <= SHORT, sizes, 0), sizes) - (np.arange(len(gid)) - np.repeat(begins, sizes))
        for step in range(1, min(SHORT, int(sizes.max()))):
            a = np.flatnonzero(left > step)
            b = a + step
            ok = (gid[a] != gid[b]) & ((lo[a] == hi[a]) | (part[a] != part[b]))
            a, b = a[ok], b[ok]
            ok = close(wide, unit, lost, a, b, np.einsum("ij,ij->i", q[a].astype(np.float32), q[b].astype(np.float32)))
            yield np.maximum(gid[a[ok]], gid[b[ok]]), np.minimum(gid[a[ok]], gid[b[ok]])
        for begin, size in zip(begins[sizes > SHORT], sizes[sizes > SHORT]):
            at = np.arange(begin, begin + size)
            at = at[np.lexsort((-wide[at], gid[at]))]  # of a group's rows the one of largest radius
            at = at[np.concatenate([[True], np.diff(gid[at]) > 0])]
            x = q[at].astype(np.float32)
            for i in range(0, len(at), 512):
                for j in range(0, i + 1, 512):
                    a, b = at[i : i + 512], at[j : j + 512]
                    hit = close(wide, unit, lost, a[:, None], b, x[i : i + 512] @ x[j : j + 512].T) & (gid[a][:, None] > gid[b])
                    if lo[begin] != hi[begin]:
                        hit &= part[a][:, None] != part[b]
                    u, v = np.nonzero(hit)
                    if smallest:
                        u, first = np.unique(u, return_index=True)
                        v = v[first]
                    yield gid[a][u], gid[b][v]

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        widths = rows["code"].to_numpy() >> 32
        cuts = np.flatnonzero(np.diff(widths)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), rows.num_rows]):
            found = list(met(rows.slice(begin, end - begin)))
            u, v = (np.concatenate(x) for x in zip(*found)) if found else ([], [])
            if len(u):
                u, v = np.unique(np.stack([u, v]), axis=1)
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= HELD:
                rows = pa.Table.from_batches(held)
                keys = [rows[c].to_numpy() for c in ("code", "lo", "hi")]
                last = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
                whole = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on
                if whole:
                    yield from pairs(rows.slice(0, whole))
                    held = rows.slice(whole).to_batches()
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def verified(pairs: DataFrame, groups: DataFrame, within: float, least: float) -> DataFrame:
    """``(u, v, nu, nv, whole)`` of pairs of groups with a link for sure (``whole``: every member of one with every of the other) or perhaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v, nu, nv, du, dv = (b.column(i).to_numpy() for i in range(6))
            cos = np.array([float(x @ y) if len(x) == len(y) else -1.0 for x, y in zip(units(b.column(6)), units(b.column(7)))], dtype=np.float64).reshape(-1)
            spread, a = du + dv, angle(cos)
            whole = np.where(spread == 0, cos >= least, a + spread <= within - SLACK)
            perhaps = (spread > 0) & ~whole & (a - spread <= within + SLACK)
            at = np.flatnonzero(whole | perhaps)
            yield pa.record_batch([pa.array(c[at]) for c in (u, v, nu, nv, whole)], names=["u", "v", "nu", "nv", "whole"])

    side = lambda s: groups.select(F.col("gid").alias(s), F.col("n").alias(f"n{s}"), F.col("radius").alias(f"r{s}"), F.col("center").alias(f"c{s}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "nu", "nv", "ru", "rv", "cu", "cv")
    return both.mapInArrow(run, "u long, v long, nu long, nv long, whole boolean")


def member_links(pairs: DataFrame, members: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """``(row, n, u, v)``: for the members of pairs of groups how many of the other group they link with.

    Members are stored in blocks of about ``MEMBERS`` vectors; two blocks meet in a row of their own, which gives counts only.
    """
    asked = pairs.select(F.col("u").alias("gid")).union(pairs.select("v")).distinct()
    sized = members.select("row", "gid", "embedding").join(asked, "gid", "left_semi").join(groups.select("gid", "n"), "gid")
    block = F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / MEMBERS))
    blocks = sized.groupBy("gid", block.alias("b")).agg(F.collect_list(F.struct("row", "embedding")).alias("m"))
    side = lambda s: blocks.select(F.col("gid").alias(s), F.col("b").alias(f"b{s}"), F.col("m.row").alias(f"rows_{s}"), F.col("m.embedding").alias(f"x_{s}"))
    met = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v").select("u", "v", "rows_u", "x_u", "rows_v", "x_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                u, v = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                x, y = (np.stack(units(b.column(c)[i].values)) for c in (3, 5))
                hit = x @ y.T >= least
                for rows, n in ((b.column(2)[i].values, hit.sum(axis=1)), (b.column(4)[i].values, hit.sum(axis=0))):
                    at = pa.array(np.flatnonzero(n))
                    yield pa.record_batch([rows.take(at), pa.array(n[n > 0].astype(np.int64)), pa.array([u] * len(at), pa.int64()), pa.array([v] * len(at), pa.int64())], names=["row", "n", "u", "v"])

    return met.mapInArrow(run, "row long, n long, u long, v long")


def near_duplicates(vectors: DataFrame, least: float = 0.9, column: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``; links are pairs of cosine ``least`` or more.

    A vector exceeds about ``EXCEEDED`` filters of a random product code, whatever the number of vectors. Vectors that are
    within half the angle of a leader form a group: all its members link with each other, by the triangle inequality for
    angles, so copies in any number cost one comparison each. Groups that meet on a filter are compared by sketches
    of their centers; what passes is verified with the vectors in double precision: as wholes where radii decide, member by
    member in blocks where not. Counts are exact for the pairs of groups found; no list of a group's pairs is made.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing, as do vectors of different
    widths. Repeated rows, and rows of equal id, are rows of their own. A row with a null id takes part; a
    component of such rows alone has a null id and its rows are kept. An empty table gives no rows. Other columns are ignored.
    """
    within = math.acos(least)
    own = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(column).alias("embedding"))
    first = materialize(led(own, within / 2), "led")
    rows = materialize(regrouped(first, within / 2), "grouped")
    stats = rows.groupBy("gid").agg(F.count("*").alias("n"), F.max("delta").alias("radius"), F.min("vec_id").alias("least_id"))
    groups = materialize(stats.join(rows.select(F.col("row").alias("gid"), F.col("embedding").alias("center")), "gid"), "groups")
    pairs = materialize(compared(rows, within, False), "pairs")
    found = materialize(verified(pairs, groups, within, least), "verified")
    counts = materialize(member_links(found.where("not whole"), rows, groups, least), "member-links")
    sure = found.where("whole")
    roots = components(sure.select("u", "v").union(counts.select("u", "v").distinct()))
    whole = sure.select(F.col("u").alias("gid"), F.col("nv").alias("m")).union(sure.select("v", "nu")).groupBy("gid").agg(F.sum("m").alias("m"))
    rooted = groups.select("gid", "n", "least_id").join(roots, F.col("gid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "gid"))
    labels = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    per_group = rooted.join(whole, "gid", "left").join(labels, "root").select("gid", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("links"), "component_id")
    single = counts.groupBy("row").agg(F.sum("n").alias("more"))
    linked = rows.select("row", "vec_id", "gid").join(per_group, "gid").join(single, "row", "left").select("vec_id", (F.col("links") + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    alone = first.where("leader is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = materialize(linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())), "near-vectors")
    discard(first, rows, groups, pairs, found, counts)
    return out
