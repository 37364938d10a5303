"""Ordered histories, trees and graphs over events, conversations, orders and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import findings as fnd, graph, history, ordered
from codestrata.queries import Catalog, table

CATALOG = Catalog()
query = CATALOG.add

USER_ORDER = ["ts", "event_id"]


def _events(spark, d):
    return table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")


FIRST_PURCHASE_SQL = """
  p AS (SELECT *, row_number() OVER w - 1 AS pos,
               coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER
                 (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(f"WITH {FIRST_PURCHASE_SQL} SELECT user_id, event_id, event_type FROM p WHERE seen = 1")
def history_skip_until(spark, d):
    after = ordered.skip_until(_events(spark, d), ["user_id"], USER_ORDER, F.col("event_type") == "purchase")
    return after.select("user_id", "event_id", "event_type")


@query(
    f"""
    WITH {FIRST_PURCHASE_SQL}, s AS (SELECT user_id, min(pos) FILTER (WHERE event_type = 'purchase') AS skipped
                                     FROM p GROUP BY user_id)
    SELECT user_id, skipped, CASE WHEN skipped IS NULL THEN 'CanNotFindFirstCommit' END AS error FROM s
    """
)
def history_skipped_steps(spark, d):
    return ordered.skipped_steps(_events(spark, d), ["user_id"], USER_ORDER, F.col("event_type") == "purchase")


@query(
    f"""
    WITH {FIRST_PURCHASE_SQL}
    SELECT user_id, event_id FROM p WHERE seen = 1
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5
    """
)
def history_limit_after(spark, d):
    first = ordered.limit_after(_events(spark, d), ["user_id"], USER_ORDER, F.col("event_type") == "purchase", 5)
    return first.select("user_id", "event_id")


@query(
    """
    WITH e AS (SELECT * FROM events WHERE event_type <> 'signup'),
         p AS (SELECT *, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER
                 (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bad FROM e)
    SELECT user_id, event_id, event_type FROM p WHERE bad = 0
    """
)
def history_take_while(spark, d):
    """Rows before a user's first error; signups neither stop the walk nor stay."""
    kept = ordered.take_while(
        _events(spark, d), ["user_id"], USER_ORDER, F.col("event_type") != "error", skip=F.col("event_type") == "signup"
    )
    return kept.select("user_id", "event_id", "event_type")


@query(
    """
    SELECT conv_id, turn, role, lag(role) OVER w AS prev_role, lead(role) OVER w AS next_role,
           row_number() OVER w - 1 AS position
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
    """
)
def cursor(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return ordered.cursor(turns, ["conv_id"], ["turn"], ["role"])


@query(
    """
    SELECT doc_id, source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 30) AS BIGINT) AS batch
    FROM documents
    """
)
def batches(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return ordered.batches(docs, ["source"], ["doc_id"], 30)


@query(
    """
    SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS scope
    FROM events
    """
)
def carry_scope(spark, d):
    """The last purchase carried down to every later event of the user."""
    mark = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    scoped = ordered.carry_down(_events(spark, d), ["user_id"], USER_ORDER, {"scope": mark})
    return scoped.select("user_id", "event_id", "scope")


def _turn_trees(spark, d):
    """Each turn is a commit (newest first), its words are the tree's paths, a word's count its content."""
    turns = table(spark, d, "conversations").select(
        F.col("conv_id").alias("repo"), "turn", F.concat_ws(":", "conv_id", "turn").alias("tree_oid"), "text"
    )
    last = turns.groupBy("repo").agg(F.max("turn").alias("_last"))
    commits = turns.join(last, "repo").select("repo", (F.col("_last") - F.col("turn")).alias("ord"), "tree_oid")
    entries = (
        turns.select("repo", "tree_oid", F.explode(F.split("text", " ")).alias("path"))
        .groupBy("repo", "tree_oid", "path")
        .agg(F.count(F.lit(1)).cast("string").alias("oid"))
    )
    return commits, entries


TURN_TREES_SQL = """
  t AS (SELECT conv_id AS repo, max(turn) OVER (PARTITION BY conv_id) - turn AS ord, text FROM conversations),
  e AS (SELECT repo, ord, path, CAST(count(*) AS VARCHAR) AS oid
        FROM (SELECT repo, ord, unnest(string_split(text, ' ')) AS path FROM t) GROUP BY ALL),
  pairs AS (SELECT repo, ord FROM t WHERE ord > 0),
  o AS (SELECT p.repo, p.ord, e.path, e.oid FROM pairs p JOIN e ON e.repo = p.repo AND e.ord = p.ord - 1),
  n AS (SELECT p.repo, p.ord, e.path, e.oid FROM pairs p JOIN e ON e.repo = p.repo AND e.ord = p.ord),
  delta AS (SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.ord, n.ord) AS ord, coalesce(o.path, n.path) AS path,
                   CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change,
                   o.oid AS old_oid, n.oid AS new_oid
            FROM o FULL JOIN n ON o.repo = n.repo AND o.ord = n.ord AND o.path = n.path
            WHERE o.oid IS DISTINCT FROM n.oid)"""


@query(f"WITH {TURN_TREES_SQL} SELECT * FROM delta")
def history_diff(spark, d):
    return history.history_diff(*_turn_trees(spark, d))


@query(
    f"""
    WITH {TURN_TREES_SQL}, h AS (SELECT DISTINCT repo, ord FROM delta WHERE path LIKE '%tion%'),
         f AS (SELECT repo, min(ord) AS first_hit FROM h GROUP BY repo)
    SELECT t.repo, t.ord FROM t JOIN f USING (repo) WHERE t.ord > f.first_hit AND t.ord <= f.first_hit + 2
    """
)
def history_after_change(spark, d):
    """The two steps after the first one that touches a path mentioning 'tion'."""
    commits, entries = _turn_trees(spark, d)
    delta = history.history_diff(commits, entries).withColumn("other", F.col("path"))
    hits = history.touches_build(delta, "path", "other", ["tion"]).select("repo", "ord").distinct()
    steps = commits.join(hits.withColumn("hit", F.lit(True)), ["repo", "ord"], "left")
    return ordered.limit_after(steps, ["repo"], ["ord"], F.col("hit"), 2).select("repo", "ord")


@query(
    """
    WITH o AS (SELECT l_linenumber, l_orderkey, count(*) AS oid FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
         n AS (SELECT l_linenumber, l_orderkey, count(*) AS oid FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL)
    SELECT coalesce(o.l_linenumber, n.l_linenumber) AS l_linenumber, coalesce(o.l_orderkey, n.l_orderkey) AS l_orderkey,
           CASE WHEN o.oid IS NULL THEN 'added' WHEN n.oid IS NULL THEN 'deleted' ELSE 'modified' END AS change,
           o.oid AS old_oid, n.oid AS new_oid
    FROM o FULL JOIN n ON o.l_linenumber = n.l_linenumber AND o.l_orderkey = n.l_orderkey
    WHERE o.oid IS DISTINCT FROM n.oid
    """
)
def tree_diff(spark, d):
    """Lines without flag N as the old tree, those without flag A as the new one; R is in both."""
    lines = table(spark, d, "lineitem")
    keys = ["l_linenumber", "l_orderkey"]

    def tree(without):
        return lines.where(F.col("l_returnflag") != without).groupBy(*keys).agg(F.count(F.lit(1)).alias("oid"))

    return history.tree_diff(tree("N"), tree("A"), keys)


@query(
    """
    SELECT event_id, user_id, c_nationkey FROM events JOIN customer ON c_custkey = user_id
    """
)
def history_lookup(spark, d):
    """Rows found by id: the customer with the number of the event's user."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    return history.lookup(customers, table(spark, d, "events").select("event_id", "user_id"), ["user_id"])


@query("SELECT doc_id, 'no such commit' AS error FROM documents ANTI JOIN labels USING (doc_id)")
def history_missing(spark, d):
    """Requested ids without a row: documents nobody labelled."""
    requests = table(spark, d, "documents").select("doc_id")
    return history.missing(table(spark, d, "labels"), requests, ["doc_id"], "no such commit")


@query(
    """
    SELECT c.conv_id, c.turn, c.role FROM conversations c
    JOIN (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id) USING (conv_id, turn)
    """
)
def history_heads(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("repo"), "turn", "role")
    newest = history.tips(turns.withColumn("ord", -F.col("turn")), oid="turn")
    refs = newest.select("repo", F.lit("HEAD").alias("name"), F.col("turn").alias("oid"))
    return history.head_commit(refs, turns.withColumnRenamed("turn", "oid")).select(
        F.col("repo").alias("conv_id"), F.col("oid").alias("turn"), "role"
    )


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS position FROM conversations")
def rev_walk(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role").withColumn("_newest", -F.col("turn"))
    walked = ordered.with_position(turns, ["conv_id"], ["_newest"]).drop("_newest")
    return history.rev_walk(walked, ["conv_id"], "position")


@query(
    """
    WITH RECURSIVE e AS (SELECT conv_id, turn AS oid, turn - 3 AS parent FROM conversations
                         UNION ALL SELECT conv_id, turn, turn - 1 FROM conversations WHERE turn % 4 <> 0),
         w AS (SELECT conv_id, turn AS oid, CAST(0 AS BIGINT) AS g FROM conversations
               UNION SELECT e.conv_id, e.oid, w.g + 1 FROM w JOIN e ON e.conv_id = w.conv_id AND e.parent = w.oid),
         t AS (SELECT conv_id AS repo, oid, max(g) AS generation FROM w GROUP BY ALL)
    SELECT repo, oid, generation, row_number() OVER (PARTITION BY repo ORDER BY generation DESC, oid DESC) - 1 AS ord FROM t
    """
)
def topological_walk(spark, d):
    """A walk from the parents alone: a turn answers the third before, which is longer than it looks, and most the one before."""
    turn = F.col("turn")
    parents = F.array_compact(F.array(turn - 3, F.when(turn % 4 != 0, turn - 1)))
    commits = table(spark, d, "conversations").select(F.col("conv_id").alias("repo"), turn.alias("oid"), parents.alias("parents"))
    return history.topological_walk(commits).select("repo", "oid", "generation", "ord")


@query(
    """
    WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS generation FROM orders)
    SELECT o_custkey AS repo, o_orderkey AS oid, generation FROM o
    """
)
def order_generations(spark, d):
    """A linear history of each customer's orders, its only parent the order before."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("oid"))
    chained = ordered.cursor(orders, ["repo"], ["oid"], ["oid"])
    return graph.generations(chained.select("repo", "oid", F.array_compact(F.array("prev_oid")).alias("parents")))


@query("SELECT conv_id, count(*) AS entries FROM conversations GROUP BY conv_id")
def entry_count(spark, d):
    return history.entry_count(table(spark, d, "conversations"), ["conv_id"])


@query(
    """
    WITH RECURSIVE h AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id),
    r AS (SELECT conv_id, turn FROM h UNION
          SELECT c.conv_id, c.turn FROM r JOIN conversations c ON c.conv_id = r.conv_id
              AND (c.turn = r.turn - 1 OR c.turn = r.turn - 3))
    SELECT conv_id AS repo, turn AS oid FROM r
    """
)
def history_ancestors(spark, d):
    """Everything reachable from the last turn, where a turn answers the one before and the third before."""
    turns = table(spark, d, "conversations")
    parents = F.filter(F.array(F.col("turn") - 1, F.col("turn") - 3), lambda t: t >= 0)
    commits = turns.select(F.col("conv_id").alias("repo"), F.col("turn").alias("oid"), parents.alias("parents"))
    heads = commits.groupBy("repo").agg(F.max("oid").alias("oid"))
    return graph.ancestors(commits, heads)


@query(
    """
    SELECT split_part(url, '/', 3) AS root, 
           array_to_string(string_split(url, '/')[4:], '/') AS path, count(*) AS n
    FROM pages GROUP BY ALL
    """
)
def tree_paths(spark, d):
    """URL components as nested trees (host / section / page), flattened back to full paths."""
    parts = F.split("url", "/")
    pages = table(spark, d, "pages").select("page_id", F.slice(parts, 3, 2**30).alias("p"))
    level = F.posexplode(F.sequence(F.lit(1), F.size("p") - 1)).alias("_i", "depth")
    nodes = pages.select("page_id", "p", level).select(
        F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("tree_oid"),
        F.element_at("p", F.col("depth") + 1).alias("name"),
        F.when(F.col("depth") + 1 == F.size("p"), "blob").otherwise("tree").alias("kind"),
        F.when(F.col("depth") + 1 == F.size("p"), F.concat(F.lit("page:"), F.col("page_id").cast("string")))
        .otherwise(F.array_join(F.slice("p", F.lit(1), F.col("depth") + 1), "/"))
        .alias("oid"),
    ).distinct()
    roots = pages.select(F.element_at("p", 1).alias("tree_oid")).distinct()
    flat = graph.flatten_trees(roots, nodes, keys=[])
    return flat.groupBy("root", "path").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
    SELECT split_part(url, '/', 3) AS host,
           CASE WHEN bool_or(split_part(url, '/', 4) = 'en') THEN 'English'
                WHEN bool_or(split_part(url, '/', 4) = 'de') THEN 'German' ELSE 'Other' END AS generator
    FROM pages GROUP BY 1
    """
)
def generator_kind(spark, d):
    parts = F.split("url", "/")
    entries = table(spark, d, "pages").select(parts[2].alias("host"), F.get(parts, F.lit(3)).alias("name"))
    return history.generator_kind(
        entries, ["host"], preference=[("en", "English"), ("de", "German")], default="Other"
    )


def _role_calls(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    moves = ordered.cursor(turns, ["conv_id"], ["turn"], ["role"]).where(F.col("next_role").isNotNull())
    return moves.select("conv_id", F.col("role").alias("caller"), F.col("next_role").alias("callee"))


MOVES_SQL = """(SELECT conv_id, role AS caller, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS callee
    FROM conversations)"""


@query(f"SELECT caller, callee, count(*) AS calls FROM {MOVES_SQL} WHERE callee IS NOT NULL GROUP BY ALL")
def co_edges(spark, d):
    return graph.call_edges(_role_calls(spark, d), [])


@query(
    f"""
    WITH p AS (SELECT DISTINCT caller, callee FROM {MOVES_SQL} WHERE callee IS NOT NULL),
         f AS (SELECT caller AS function, 1 AS o, 0 AS i FROM p UNION ALL SELECT callee, 0, 1 FROM p)
    SELECT function, CAST(sum(o) AS BIGINT) AS callees, CAST(sum(i) AS BIGINT) AS callers FROM f GROUP BY 1
    """
)
def call_degree(spark, d):
    return graph.call_degree(graph.call_edges(_role_calls(spark, d), []), [])


@query(
    """
    WITH RECURSIVE e AS (SELECT DISTINCT n1.n_regionkey AS a, s.s_nationkey + 100 AS b
                         FROM supplier s JOIN nation n1 ON n1.n_nationkey = s.s_nationkey
                         UNION SELECT DISTINCT s.s_nationkey + 100, s.s_suppkey + 1000 FROM supplier s
                         UNION SELECT DISTINCT l_suppkey + 1000, l_partkey + 1000000 FROM lineitem),
    r(node, parent, depth, path) AS (
      SELECT CAST(r_regionkey AS BIGINT), CAST(NULL AS BIGINT), 0, CAST(r_regionkey AS VARCHAR) FROM region
      UNION ALL
      SELECT e.b, r.node, r.depth + 1, r.path || '>' || e.b FROM r JOIN e ON e.a = r.node)
    SELECT CAST(node AS BIGINT) AS function, min(depth) AS steps, coalesce(arg_min(path, parent), min(path)) AS path FROM r GROUP BY node
    """
)
def call_paths(spark, d):
    """Shortest chains region > nation > supplier > part; every reachable node once, with its path."""
    suppliers = table(spark, d, "supplier")
    nations = table(spark, d, "nation")
    lines = table(spark, d, "lineitem")
    nation_id = F.col("s_nationkey").cast("bigint") + 100
    edges = (
        suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey)
        .select(F.col("n_regionkey").cast("bigint").alias("caller"), nation_id.alias("callee"))
        .union(suppliers.select(nation_id, F.col("s_suppkey") + 1000))
        .union(lines.select(F.col("l_suppkey") + 1000, F.col("l_partkey") + 1000000))
    )
    roots = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("function"))
    found = graph.call_paths(graph.call_edges(edges, []), roots, [])
    return found.select("function", (F.size("path") - 1).alias("steps"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(
    """
    SELECT user_id, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) AS status, count(*) AS events,
           bool_or(event_type = 'error') AS failed
    FROM events GROUP BY user_id
    """
)
def status_latest(spark, d):
    from codestrata.streaming.logs import run_status

    return run_status(_events(spark, d), "user_id", "event_type", USER_ORDER, "error")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def event_kinds(spark, d):
    return fnd.verdict_tally(_events(spark, d), "event_type")
