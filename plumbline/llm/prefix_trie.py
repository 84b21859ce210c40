"""The trie of conversation prefixes, by names of power-of-two blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.llm.common import body, keep, range_partitions, scratch, stored, table
from plumbline.session import ship

#: Nodes of one owner that a window takes at once.
SLICE = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, i, mark, chars): turns numbered from 1 in each conversation, by turn (null first), then by digest.

    ``mark`` is a digest of role and text (null: empty), ``chars`` the text's code points. Rows are range-partitioned by
    conversation and turn, so that a long conversation lies in several partitions; a row's number is its place in its
    partition plus the rows of its conversation in earlier ones. Rows without a conversation's id belong to none.
    """
    role, text = body(role_col), body(text_col)
    mark = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), mark.alias("mark"), F.length(text).cast("long").alias("chars")).filter("conv_id IS NOT NULL")
    place = ["conv_id", F.col("turn").asc_nulls_first(), "mark"]
    rows = rows.repartitionByRange(range_partitions(turns.sparkSession, 0), *place).sortWithinPartitions(*place)
    rows = stored(rows.select("conv_id", "mark", "chars", F.monotonically_increasing_id().alias("m")), "trie-turns")
    part = F.shiftright("m", 33).alias("part")
    cells = rows.groupBy("conv_id", part).agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return rows.select("*", part).join(cells, ["conv_id", "part"]).select("conv_id", (F.col("m") + F.col("shift")).alias("i"), "mark", "chars")


def lengths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def spliced(rows: DataFrame, sizes: DataFrame, leader: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first ``head`` turns (``most`` at most) of their ``leader``, all of them if it has
    fewer and none if it does not exist, and go on with their own turns after the first ``head``."""
    plan = sizes.select("conv_id", "n", leader.alias("leader"), head.cast("long").alias("head"))
    whole = sizes.select(F.col("conv_id").alias("leader"), F.col("n").alias("lead_n"))
    plan = plan.join(whole, "leader", "left").withColumn("lead", F.least("head", F.coalesce("lead_n", F.lit(0))))
    plan = stored(plan.select("conv_id", "leader", "head", "lead", (F.col("lead") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("n")), "trie-plan")
    own = rows.join(plan, "conv_id").filter("i > head").select("conv_id", (F.col("i") - F.col("head") + F.col("lead")).alias("i"), "mark", "chars")
    first = rows.filter(F.col("i") <= most).select(F.col("conv_id").alias("leader"), "i", "mark", "chars")
    lead = plan.filter("lead > 0").join(first, "leader").filter("i <= lead").select("conv_id", "i", "mark", "chars")
    return own.unionByName(lead), plan.select("conv_id", "n")


def named(rows: DataFrame, *by: str) -> DataFrame:
    """Adds ``name``, a number from 0 without gaps for each distinct ``by``, and drops these columns."""
    keys = stored(rows.select(*by).distinct().select(*by, F.monotonically_increasing_id().alias("m")), "trie-keys")
    part = F.shiftright("m", 33)
    ahead = keys.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    ahead = ahead.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    keys = keys.withColumn("part", part).join(F.broadcast(ahead), "part")  # a row a partition
    keys = keys.select(*by, (F.col("ahead") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("name"))
    return rows.join(keys, list(by)).drop(*by)


def prefix_names(rows: DataFrame, longest: int) -> DataFrame:
    """(conv_id, depth, name): two prefixes of one depth have one name where all their turns are equal.

    Blocks of 2^k turns at multiples of 2^k get their names from pairs of half as long ones, in log2(longest) rounds of joins. A
    prefix is cut by the binary digits of its length, longest block first: that of length d is named by the prefix without
    its last block and that block. Each round names what the round before made possible; all rounds together move a few rows a turn.
    """
    blocks = [stored(named(rows.select("conv_id", (F.col("i") - 1).alias("j"), "mark"), "mark"), "trie-blocks")]
    while 2 << len(blocks) - 1 <= longest:
        half = lambda odd, out, b=blocks[-1]: b.filter(F.col("j") % 2 == odd).select("conv_id", F.shiftright("j", 1).alias("j"), F.col("name").alias(out))
        blocks.append(stored(named(half(0, "a").join(half(1, "b"), ["conv_id", "j"]), "a", "b"), "trie-blocks"))
    found: DataFrame | None = None
    for k in range(len(blocks) - 1, -1, -1):
        starts = blocks[k].filter(F.col("j") % 2 == 0).select("conv_id", F.shiftleft("j", k).alias("depth"), "name")
        now = starts.filter("depth = 0").select("conv_id", F.lit(1 << k).cast("long").alias("depth"), "name")  # a block alone
        if found is not None:
            pairs = starts.filter("depth > 0").withColumnRenamed("name", "b").join(found.withColumnRenamed("name", "a"), ["conv_id", "depth"])
            pairs = stored(named(pairs.withColumn("depth", F.col("depth") + (1 << k)), "a", "b"), "trie-prefixes")
            now = now.unionByName(pairs)
        found = now if found is None else found.unionByName(now)
    return found


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (owner, depth, ids) to one digest each; ids arrive in order and are not held."""
    now, state = None, None
    for x in batches:
        out = []
        for owner, depth, ids in zip(x["owner"].to_pylist(), x["depth"].to_pylist(), x["ids"]):
            text = ",".join(map(str, ids.as_py())).encode()
            if (owner, depth) == now:
                state.update(b"," + text)
            else:
                if now:
                    out.append((*now, state.hexdigest()))
                now, state = (owner, depth), hashlib.sha256(text)
        yield _ends(out)
    if now:
        yield _ends([(*now, state.hexdigest())])


def _ends(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["owner", "depth", "ends"])


def prefix_trie(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nodes of the trie of ``rows`` (conv_id, i, mark, chars), turns numbered from 1, and ``sizes`` (conv_id, n): one
    row each for the conversations' distinct sequences of first ``depth`` turns, the root (depth 0) included.

    conv_id is the smallest conversation that begins with the sequence: with ``depth`` it names the node and its text.
    parent_conv_id likewise names the parent (null for the root); n_convs counts the conversations that begin with it,
    n_children its children, n_leaves the childless nodes below it, itself included; saved_tokens sums (n_convs - 1) times the code
    points of the last text over its subtree; ends_sha256 is the digest of the ids, in order and joined by commas, of the
    conversations that end there. A conversation without turns is a member of the root. No conversations, no nodes.

    A conversation owns the nodes whose smallest member it is: the end of its path. A subtree's sum is then what the
    node's members own, less what its owner owns above it, so that no ancestors are walked. Equal prefixes of very many
    conversations are aggregated before the shuffle; joins on hot names or long conversations are plain shuffles, which adaptive
    execution splits; sums along a path are made in slices. Ids that end at one node are sorted in range partitions and stream
    through the digest, which is sequential by nature: a chunk of ids at a time is all a task holds.
    """
    spark = rows.sparkSession
    ship(spark)
    with scratch(spark):
        rows, sizes = stored(rows, "trie-rows"), stored(sizes, "trie-sizes")
        top, n_all, longest = sizes.agg(F.min("conv_id"), F.count(F.lit(1)), F.max("n")).first()
        if not n_all:
            return spark.createDataFrame([], NODE)
        if longest:
            paths = prefix_names(rows, longest)
        else:
            paths = spark.createDataFrame([], "conv_id long, depth long, name long")
        nodes = paths.groupBy("depth", "name").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"))
        nodes = nodes.join(rows.select(F.col("conv_id").alias("owner"), F.col("i").alias("depth"), "chars"), ["owner", "depth"])
        root = spark.range(1).select(F.lit(top).cast("long").alias("owner"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), F.lit(n_all).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("chars"))
        nodes = nodes.select("owner", "depth", "name", "n_convs", "chars").unionByName(root)
        nodes = stored(nodes.join(sizes.withColumnRenamed("conv_id", "owner"), "owner"), "trie-nodes")

        # Where an owner's path leaves another one's.
        tops = nodes.groupBy("owner").agg(F.min("depth").alias("s")).filter("s > 0").select("owner", (F.col("s") - 1).alias("depth"))
        inner = tops.filter("depth > 0").join(paths.withColumnRenamed("conv_id", "owner"), ["owner", "depth"])
        inner = inner.join(nodes.select("depth", "name", F.col("owner").alias("parent")), ["depth", "name"]).select("owner", "depth", "parent")
        forks = stored(inner.unionByName(tops.filter("depth = 0").withColumn("parent", F.lit(top).cast("long"))), "trie-forks")
        branches = forks.groupBy(F.col("parent").alias("owner"), "depth").agg(F.count(F.lit(1)).alias("branches"))
        nodes = nodes.join(branches, ["owner", "depth"], "left")
        nodes = nodes.join(forks.select("owner", (F.col("depth") + 1).alias("depth"), F.col("parent").alias("fork")), ["owner", "depth"], "left")
        nodes = nodes.withColumn("n_children", F.coalesce("branches", F.lit(0)) + (F.col("depth") < F.col("n")).cast("long"))
        nodes = nodes.select("owner", "depth", "name", "n_convs", "n_children", F.when(F.col("depth") > 0, F.coalesce("fork", "owner")).alias("parent"), ((F.col("n_convs") - 1) * F.col("chars")).alias("own"))
        nodes = stored(nodes, "trie-nodes")

        # What each owner has, what the members of each node have, and what stands above a node on its owner's path.
        owned = nodes.groupBy("owner").agg(F.sum("own").alias("own"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
        owned = stored(owned.withColumnRenamed("owner", "conv_id"), "trie-owned")
        below = paths.join(owned, "conv_id").groupBy("depth", "name").agg(F.sum("own").alias("all_own"), F.sum("leaves").alias("n_leaves"))
        all_of = owned.agg(F.sum("own").alias("all_own"), F.sum("leaves").alias("n_leaves")).select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), "all_own", "n_leaves")
        below = stored(below.unionByName(all_of), "trie-below")
        up = Window.partitionBy("owner", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
        cells = nodes.groupBy("owner", F.floor(F.col("depth") / SLICE).alias("slice")).agg(F.sum("own").alias("own"))
        cells = cells.select("owner", "slice", F.coalesce(F.sum("own").over(Window.partitionBy("owner").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
        cells = stored(cells.filter("ahead > 0"), "trie-cells")
        line = nodes.withColumn("slice", F.floor(F.col("depth") / SLICE)).select("*", F.coalesce(F.sum("own").over(up), F.lit(0)).alias("above"))
        line = line.join(cells, ["owner", "slice"], "left").withColumn("above", F.col("above") + F.coalesce("ahead", F.lit(0)))

        last = sizes.filter("n > 0").withColumnRenamed("n", "depth").join(paths, ["conv_id", "depth"])
        last = last.join(nodes.select("depth", "name", "owner"), ["depth", "name"]).select("owner", "depth", "conv_id")
        last = last.unionByName(sizes.filter("n = 0").select(F.lit(top).cast("long").alias("owner"), F.lit(0).cast("long").alias("depth"), "conv_id"))
        last = stored(last.repartitionByRange(range_partitions(spark, 0), "owner", "depth", "conv_id").select("*", F.spark_partition_id().alias("part")), "trie-ends")
        runs = last.groupBy("owner", "depth", "part").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))  # part of a partition
        ends = runs.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "part").select("owner", "depth", "ids").mapInArrow(_digests, "owner long, depth long, ends string")
        ends = stored(ends, "trie-digests")

        out = line.join(below, ["depth", "name"]).join(ends, ["owner", "depth"], "left")
        out = out.select(
            F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
            (F.col("all_own") - F.col("above")).alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
        )
        return keep(stored(out, "trie"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations begin with the first turns of the first one of their hundred, by a checksum of their id."""
    c = F.col("conv_id")
    rows = stored(ordered_turns(table(spark, sf_dir, "conversations")), "trie-ordered")
    rows, sizes = spliced(rows, stored(lengths(rows), "trie-lengths"), c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6, 5)
    return prefix_trie(rows, sizes)


#: The checksum of the decimal id, bit by bit.
_CRC = """(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), s -> ascii(s)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, z: xor(a >> 1, 3988292384::BIGINT * (a & 1)))), 4294967295::BIGINT) % 6)"""
SQL = {
    "op11_prefix_trie": f"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY i) AS own, {_CRC.replace('s -> ', 'lambda s: ')} AS h FROM t GROUP BY conv_id),
        r AS (SELECT c.conv_id, list_concat(coalesce(l.own, [])[1:c.h], c.own[c.h + 1:]) AS turns FROM c LEFT JOIN c l ON l.conv_id = c.conv_id - c.conv_id % 100),
        p AS (SELECT conv_id, len(turns) AS n, d, turns[1:d] AS seq FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)),
        g AS (SELECT d, seq, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d) AS ends FROM p GROUP BY d, seq),
        w AS (SELECT *, CASE WHEN d > 0 THEN (n_convs - 1) * length(seq[d].text) ELSE 0 END AS own FROM g),
        k AS (SELECT a.d, a.seq, a.conv_id, a.n_convs, a.ends, count(b.d) AS n_children FROM w a LEFT JOIN w b ON b.d = a.d + 1 AND b.seq[1:a.d] = a.seq GROUP BY ALL),
        s AS (SELECT a.d, a.seq, sum(b.own) AS saved, count(*) FILTER (k.n_children = 0) AS n_leaves FROM w a JOIN w b ON b.d >= a.d AND b.seq[1:a.d] = a.seq JOIN k ON k.d = b.d AND k.seq = b.seq GROUP BY a.d, a.seq)
        SELECT k.conv_id, k.d::BIGINT AS depth, q.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(k.ends, '')) AS ends_sha256
        FROM k JOIN s ON s.d = k.d AND s.seq = k.seq LEFT JOIN w q ON q.d = k.d - 1 AND q.seq = k.seq[1:k.d - 1] AND k.d > 0
    """,
}
