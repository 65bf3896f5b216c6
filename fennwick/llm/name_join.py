"""Join of two tables by names at a small edit distance: symmetric deletion neighbourhoods.

Names at an optimal string alignment distance of d or less have a string in common that each gives by deleting d of its code
points at most. So each side's distinct names emit the hash of every string they give, the hashes are joined, pairs that
met are made distinct, and their distance is computed in a band along the diagonal. Rows are brought in only then, as one
sum for each name: a name that a third of all rows share is one name, and copies are never paired.

A name of n code points gives n (n + 1) / 2 + 1 strings for two deletions; of a name of over ``WHOLE`` code points the first
``WHOLE`` count, as alignments at distance d keep all but d of any two equally long prefixes. The hash is a polynomial in
the code points, so all strings of all names of one length come from prefix sums, without building any string. Names whose
hashes only happen to be equal are told apart by their distance.

Every join deals both sides by key: nothing is broadcast, gathered by one task or sent to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fennwick.llm.common import materialize, table

DISTANCE = 2
#: Code points of a name from which strings are deleted; bounds what a name emits.
WHOLE = 128
#: Hashes made, and pairs compared, at once in a worker.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(name: Column) -> Column:
    """The form in which names are compared: A-Z lowered."""
    return F.translate(name, _UPPER, _LOWER)


def code_points(names: list[str], length: int) -> np.ndarray:
    """The code points, plus one, of each name up to ``length``; zero after its end."""
    out = np.zeros((len(names), length), np.uint32)
    for row, name in zip(out, names):
        points = np.frombuffer(name[:length].encode("utf-32-le", "surrogatepass"), "<u4")
        row[: len(points)] = points + 1
    return out


def deletions(names: list[str], distance: int = DISTANCE) -> np.ndarray:
    """A row for each of some names of one length: the hashes of all strings they give by ``distance`` deletions at most."""
    length, one, two = len(names[0]), *(np.uint64(pow(BASE, -k, 1 << 64)) for k in (1, 2))
    powers = np.array([pow(BASE, k, 1 << 64) for k in range(length)], np.uint64)
    sums = np.zeros((len(names), length + 1), np.uint64)
    np.cumsum(code_points(names, length).astype(np.uint64) * powers, axis=1, out=sums[:, 1:])
    whole = sums[:, -1:]
    found = [whole]
    if distance >= 1:
        i = np.arange(length)
        found.append(sums[:, i] + (whole - sums[:, i + 1]) * one)
    if distance >= 2 and length >= 2:
        i, j = np.triu_indices(length, 1)
        found.append(sums[:, i] + (sums[:, j] - sums[:, i + 1]) * one + (whole - sums[:, j + 1]) * two)
    x = np.concatenate(found, axis=1)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def neighbourhoods(names: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(key, nid): the hash of each distinct string that a name of ``names`` (nid, name) gives, with the name's id."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), [t[:WHOLE] for t in batch.column(1).to_pylist()]
            lengths = np.array([len(t) for t in texts], np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                step = max(1, CHUNK // (int(length) * (int(length) + 1) // 2 + 1))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    keys = np.sort(deletions([texts[k] for k in some], distance), axis=1)
                    new = np.ones(keys.shape, bool)
                    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    owners = np.broadcast_to(ids[some][:, None], keys.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), pa.array(owners[new])], names=["key", "nid"])

    return names.select("nid", "name").mapInArrow(emit, "key long, nid long")


def banded_distance(a: list[str], b: list[str], distance: int = DISTANCE) -> np.ndarray:
    """The optimal string alignment distance of each pair of names; ``distance`` + 1 if it is larger.

    Only cells within ``distance`` of the diagonal are computed, for all pairs at once.
    """
    k, far, n = distance, distance + 1, len(a)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.full(n, far, np.int64)
    if not n:
        return out
    longest = int(la.max())
    left = code_points(a, longest)
    right = np.zeros((n, longest + 2 * k + 2), np.uint32)  # column k + j holds the j-th code point
    right[:, k + 1 : k + 1 + max(longest + k, 0)] = code_points(b, longest + k)
    t = np.arange(2 * k + 1)
    before, last = np.full((n, 2 * k + 1), far, np.int64), np.where(t >= k, t - k, far)[None, :].repeat(n, axis=0)
    last[(t[None, :] - k) > lb[:, None]] = far
    rows = np.arange(n)

    def settle(i: int, line: np.ndarray) -> None:
        at = lb - i + k
        ends = (la == i) & (at >= 0) & (at <= 2 * k)
        out[ends] = np.minimum(line[rows[ends], at[ends]], far)

    settle(0, last)
    for i in range(1, longest + 1):
        j = i + t - k  # which code point of b each cell ends with
        line = last + (left[:, i - 1 : i] != right[:, i : i + 2 * k + 1])
        line[:, :-1] = np.minimum(line[:, :-1], last[:, 1:] + 1)
        if i >= 2:
            swapped = (left[:, i - 1 : i] == right[:, i - 1 : i + 2 * k]) & (left[:, i - 2 : i - 1] == right[:, i : i + 2 * k + 1]) & (j >= 2)[None, :]
            line = np.where(swapped, np.minimum(line, before + 1), line)
        line[:, j < 0] = far
        line[:, j == 0] = i
        line[j[None, :] > lb[:, None]] = far
        for c in range(1, 2 * k + 1):
            inserted = line[:, c - 1] + 1
            line[:, c] = np.where((j[c] >= 1) & (j[c] <= lb), np.minimum(line[:, c], inserted), line[:, c])
        before, last = last, np.minimum(line, far)
        settle(i, last)
    return out


def distances(a: pd.Series, b: pd.Series, distance: int = DISTANCE) -> np.ndarray:
    """As ``banded_distance``, in groups of like length, so that one long name does not widen the others' rows."""
    size = np.maximum(a.str.len().to_numpy(), b.str.len().to_numpy())
    order, out, at = np.argsort(size, kind="stable"), np.zeros(len(a), np.int64), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and size[order[end]] <= 2 * size[order[at]] + 8 and (end - at + 1) * (size[order[end]] + 8) <= CHUNK:
            end += 1
        some = order[at:end]
        out[some] = banded_distance(a.iloc[some].tolist(), b.iloc[some].tolist(), distance)
        at = end
    return out


def near_names(left: DataFrame, right: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b, distance): the pairs of names of ``left`` and ``right`` (nid, name) at this distance or less, by their ids.

    Names are distinct and not empty; nid is any hash of the name. Names that share a hash are told apart by a later join
    on both, so such pairs may come with either: both are verified by the names themselves, which the result carries too.
    """
    if distance not in (0, 1, 2):
        raise ValueError("neighbourhoods are made for a distance of 2 at most")

    @F.pandas_udf("int")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(distances(a, b, distance)).astype("int32")

    one, two = neighbourhoods(left, distance), neighbourhoods(right, distance)
    met = one.withColumnRenamed("nid", "a").hint("merge").join(two.withColumnRenamed("nid", "b"), "key").select("a", "b").distinct()
    named = met.hint("merge").join(left.select(F.col("nid").alias("a"), F.col("name").alias("name_a")), "a")
    named = named.hint("merge").join(right.select(F.col("nid").alias("b"), F.col("name").alias("name_b")), "b")
    near = named.where(F.abs(F.length("name_a") - F.length("name_b")) <= distance)
    return near.select("name_a", "name_b", apart("name_a", "name_b").alias("distance")).where(F.col("distance") <= distance)


def join_by_name(left: DataFrame, right: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(right_id, distance, n_left, first_left_id, left_crc) for ``left`` and ``right`` tables of (id, name).

    Names are compared as they are; rows with a null or empty name take no part. Left rows are counted each, repeated ones
    too; ``left_crc`` adds the unsigned crc32 of each decimal id, a null id counts as a row and adds nothing. Repeated right
    rows are one; a right id, null or not, with several names has the sum over them. Long names are compared whole. Empty
    tables give no rows; other columns are not read.
    """
    some = lambda rows: rows.select("id", "name").where(F.col("name") != "")
    nid = F.xxhash64("name").alias("nid")
    sums = some(left).groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.sum(F.crc32(F.col("id").cast("string").cast("binary"))).alias("crc"))
    sums = materialize(sums.select(nid, "*"), "names-left")
    owners = materialize(some(right).distinct(), "names-right")
    names = materialize(owners.select("name").distinct().select(nid, "name"), "names-right-distinct")
    near = materialize(near_names(sums, names, distance), "names-near")
    met = near.hint("merge").join(sums.withColumnRenamed("name", "name_a"), "name_a")
    totals = lambda rows, key, n, least, crc: rows.groupBy(key, "distance").agg(F.sum(n).alias("n_left"), F.min(least).alias("first_left_id"), F.sum(crc).alias("left_crc"))
    by_name = materialize(totals(met, "name_b", "n", "least", "crc"), "names-sums")
    of_rows = by_name.hint("merge").join(owners.withColumnRenamed("name", "name_b"), "name_b")
    out = totals(of_rows, "id", "n_left", "first_left_id", "left_crc")
    return out.select(F.col("id").alias("right_id"), "distance", "n_left", "first_left_id", F.coalesce("left_crc", F.lit(0)).alias("left_crc"))


def misspelt(name: Column, key: Column) -> Column:
    """The name with two adjacent code points exchanged where the crc32 of the decimal key is even, at a place that it gives."""
    h, n = F.crc32(key.cast("string").cast("binary")), F.length(name)
    at = F.pmod(h, F.greatest(n - 1, F.lit(1))).cast("int")
    part = lambda start, size: name.substr(start, size)
    swapped = F.concat(part(F.lit(1), at), part(at + 2, F.lit(1)), part(at + 1, F.lit(1)), part(at + 3, F.greatest(n, F.lit(0))))
    return F.when((h % 2 == 0) & (n >= 2), swapped).otherwise(name)


def op13_names(spark, sf_dir: str) -> DataFrame:
    """Clients by vendor and distance of their names, the vendors' being misspelt first."""
    clients = table(spark, sf_dir, "clients").select(F.col("client_id").alias("id"), folded(F.col("name")).alias("name"))
    vendors = table(spark, sf_dir, "vendors").select(F.col("vendor_id").alias("id"), folded(misspelt(F.col("name"), F.col("vendor_id"))).alias("name"))
    found = join_by_name(clients, vendors)
    return found.select(F.col("right_id").alias("vendor_id"), "distance", F.col("n_left").alias("n_clients"), F.col("first_left_id").alias("first_client_id"), F.col("left_crc").alias("clients_crc"))


#: The crc32 of a decimal number, from a list ``crc`` of the remainders of all bytes.
_CRC = "xor(4294967295, list_reduce(list_transform(string_split({0}::varchar, ''), lambda x: unicode(x)::bigint), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295::bigint))"
#: All pairs, and the distance by whole rows of the matrix.
SQL = f"""
with bytes as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n)) as crc),
c as (select client_id, translate(name, '{_UPPER}', '{_LOWER}') as name, {_CRC.format("client_id")} as h from clients, bytes),
v0 as (select vendor_id, name, length(name) as n, {_CRC.format("vendor_id")} as h from vendors, bytes),
v1 as (select vendor_id, case when h % 2 = 0 and n >= 2
  then name[1 : h % (n - 1)] || name[h % (n - 1) + 2] || name[h % (n - 1) + 1] || name[h % (n - 1) + 3 :] else name end as name from v0),
v as (select vendor_id, translate(name, '{_UPPER}', '{_LOWER}') as name from v1),
near as (select a.name as a, b.name as b, string_split(a.name, '') as x, string_split(b.name, '') as y
  from (select distinct name from c where name <> '') a, (select distinct name from v where name <> '') b where abs(length(a.name) - length(b.name)) <= 2),
rows as (select a, b, list_reduce(list_transform(range(1, len(x) + 1), lambda i: [[i], [i]]), lambda m, r: [m[2],
  list_reduce(list_transform(range(1, len(y) + 1), lambda j: [j]), lambda l, j: list_append(l, least(l[j[1]] + 1, m[2][j[1] + 1] + 1, m[2][j[1]] + (x[r[1][1]] <> y[j[1]])::bigint,
    case when r[1][1] > 1 and j[1] > 1 and x[r[1][1]] = y[j[1] - 1] and x[r[1][1] - 1] = y[j[1]] then m[1][j[1] - 1] + 1 else 99 end)), r[1])],
  [range(0, len(y) + 1), range(0, len(y) + 1)]) as m from near),
pairs as (select a, b, m[2][-1] as distance from rows where m[2][-1] <= 2)
select v.vendor_id, p.distance::int as distance, count(*) as n_clients, min(c.client_id) as first_client_id, sum(c.h)::bigint as clients_crc
from pairs p join c on c.name = p.a join v on v.name = p.b group by v.vendor_id, p.distance
"""
