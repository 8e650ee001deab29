"""Candidate generation and matching: from persons to match edges.

The reference compares every pair inside an e-mail bucket and inside every
blocking-key bucket. That is quadratic in the bucket size, and a bucket can
hold a large share of all rows (a shared office mailbox, a common name). The
jobs below give the same connected components without enumerating the pairs
of a bucket:

* **Nodes.** Persons collapse to *nodes*: the distinct values of the columns a
  rule reads. Two persons with the same node value always match each other,
  so a node is linked as a star (every member -> smallest member id); exact
  copies of one record therefore cost one edge each, never a square.
* **E-mail rule.** Inside one mailbox every pair is linked except
  shared-mailbox couples, and a couple needs the same campus, street and city.
  A mailbox whose members span two or more such address classes, or that has
  a member without full address, is therefore one component and becomes a
  star. In a single-address mailbox incompatible city suffixes link whole suffix
  classes; else distinct ``(city suffix, first names)`` nodes with matching names are
  linked.
* **Block rules.** Block keys are ``fcs`` = (first token, city, street) and
  ``fl`` = (first token, last token) (the reference's ``lf`` key holds exactly
  the ``fl`` people, so it adds nothing). Rule pairs are formed between the
  *distinct* name/address nodes of a block, and only between nodes that share what
  the rule needs: a subset's token, the shape of initials, a swapped token. A block
  of many variants that match nobody costs no pairs.
* **Swapped names.** The swapped rule is directional (which person is ``a``
  depends on id order) and the couple rule may veto it. The members of a name are
  linked already, so one allowed pair decides for two names. It is read off the
  names' ends: the smallest (largest) id, and the smallest (largest) of another
  mailbox and address, since a couple shares both. Names that meet are found by a
  token of each of the two name parts at once.

Every output row is an undirected edge ``(src, dst)`` between person ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doppel.functions import normalize as N
from doppel.functions import predicates as P
from doppel.session import ensure_checkpoint_dir

# rows that may be sent to every task
BROADCAST_ROWS = 100_000
# a pair of names: representative and tokens of both sides
CANDIDATE = ["l_rep", "l_first_t", "l_last_t", "r_rep", "r_first_t", "r_last_t"]
FEATURE_COLUMNS = ["email_n", "campus_id", "first_t", "last_t", "city_main", "city_by", "street_n"]


def person_features(persons: DataFrame) -> DataFrame:
    """Normalised match columns of every person record.

    Reads only ``person_id, campus_id, first_name, last_name, email, street,
    city``; Catalyst prunes the rest of the scan.
    """
    city = N.city_parts("city")
    first_t = N.name_tokens("first_name")
    last_t = N.name_tokens("last_name")
    emails = F.col("emails") if "emails" in persons.columns else None
    return (persons
            .where(F.col("person_id") > 0)
            .select(F.col("person_id").cast("long").alias("person_id"),
                    F.coalesce(F.col("campus_id").cast("long"), F.lit(0)).alias("campus_id"),
                    N.normalize_email(N.primary_email("email", emails)).alias("email_n"),
                    first_t.alias("first_t"),
                    last_t.alias("last_t"),
                    city["main"].alias("city_main"),
                    city["by"].alias("city_by"),
                    N.normalize_street("street").alias("street_n"))
            .withColumn("first0", F.when(F.size("first_t") > 0, F.col("first_t")[0]))
            .withColumn("last0", F.when(F.size("last_t") > 0, F.col("last_t")[0])))


def written_features(persons: DataFrame) -> DataFrame:
    """``person_features`` written once to the shared folder.

    The jobs below read them in many branches; from a written copy each branch has a small
    plan, and a lost executor costs a re-read. The records are dealt out before they are
    normalised, as a file of few row groups would leave that and all branches to few tasks.
    """
    spark = persons.sparkSession
    read = ["person_id", "campus_id", "first_name", "last_name", "email", "street", "city"]
    read += [c for c in ("emails",) if c in persons.columns]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = persons.where(F.col("person_id") > 0).select(*read).repartition(tasks, "person_id")
    return _kept(person_features(dealt))


def _kept(rows: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint(eager=True)


def _held(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows written once, marked for broadcast or for a shuffle by their true number, and that number."""
    held = _kept(rows)
    n = held.count()
    return (F.broadcast(held) if n <= BROADCAST_ROWS else held.hint("merge")), n


def block_keys(features: DataFrame, swap_keys: bool = False) -> DataFrame:
    """one row per (person, blocking key) as the reference builds them."""
    fcs = F.when((F.size("first_t") > 0) & (F.col("city_main") != "") & (F.col("street_n") != ""),
                 F.concat(F.lit("fcs:"), F.col("first0"), F.lit("|"), F.col("city_main"), F.lit("|"), F.col("street_n")))
    has_names = (F.size("first_t") > 0) & (F.size("last_t") > 0)
    fl = F.when(has_names, F.concat(F.lit("fl:"), F.col("first0"), F.lit("|"), F.col("last0")))
    lf = F.when(has_names, F.concat(F.lit("lf:"), F.col("last0"), F.lit("|"), F.col("first0")))
    keys = [fcs, fl, lf]
    if swap_keys:
        keys.append(F.when(has_names, F.concat(F.lit("sw:"), F.least("first0", "last0"), F.lit("|"),
                                               F.greatest("first0", "last0"))))
    return features.select("person_id", F.explode(F.array_compact(F.array(*keys))).alias("block_key"))


def _pairs_within(nodes: DataFrame, key: list[str], attrs: list[str]) -> DataFrame:
    """Distinct node pairs that share ``key`` (``l_*`` / ``r_*`` columns, l.rep < r.rep)."""
    left = nodes.select(*key, *[F.col(c).alias(f"l_{c}") for c in attrs])
    right = nodes.select(*key, *[F.col(c).alias(f"r_{c}") for c in attrs])
    return left.join(right, on=key, how="inner").where(F.col("l_rep") < F.col("r_rep"))


def _side_columns(nodes: DataFrame, side: str, attrs: list[str]) -> list[Column]:
    return [F.col(c).alias(f"{side}_{c}") for c in attrs]


def _asked(tokens: Column) -> Column:
    """One token of a name, not the leading one (which a whole block shares) if there is another."""
    return F.array_max(F.transform(tokens, lambda t, i: F.struct((i > 0).alias("own"), F.xxhash64(t).alias("h"), t.alias("t"))))["t"]


def _subset_candidates(nodes: DataFrame, block: list[str], tokens: str, attrs: list[str], rarest: bool = False) -> DataFrame:
    """Node pairs of a block whose ``tokens`` may be a subset (left) and its superset (right).

    The right side stands under each of its tokens, the left one asks with a single token, one
    that the whole block does not share if it has any. So the pairs follow the number of true
    subsets, not the square of the variants. ``rarest`` is for blocks in which names that have
    little in common may share a further token, as the second part of double names: one of several
    different tokens finds its supersets among nodes of several, and asks with the token that the
    fewest of these have.
    """
    col, key = F.col(tokens), [*block, "_token"]
    known = nodes.where(F.size(col) > 0)
    left = [*block, *_side_columns(nodes, "l", attrs), F.size(col).alias("_l")]
    right = [*block, *_side_columns(nodes, "r", attrs), F.size(col).alias("_r")]
    under_each = known.select(*right, F.explode(F.array_distinct(col)).alias("_token"))
    if rarest:
        met = known.where(F.size(F.array_distinct(col)) == 1).select(*left, col[0].alias("_token")).join(under_each, key)
        several = known.where(F.size(F.array_distinct(col)) > 1).withColumn("_token", F.explode(F.array_distinct(col)))
        shared = several.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        # a node is its columns: an id that comes with two records may stand for two of them
        node = [*block, *[f"l_{a}" for a in attrs], "_l"]
        asking = several.select(*left, "_token").join(shared, key).groupBy(*node).agg(F.min(F.struct("_n", "_token"))["_token"].alias("_token"))
        met = met.unionByName(asking.join(several.select(*right, "_token"), key))
    else:
        met = known.select(*left, _asked(col).alias("_token")).join(under_each, key)
    return met.where("_l <= _r AND l_rep <> r_rep").drop("_l", "_r", "_token")


def _initials_candidates(nodes: DataFrame, block: list[str], attrs: list[str]) -> DataFrame:
    """Node pairs with equal first letters, one of which (left) has a one-letter token."""
    shape = F.transform("first_t", lambda t: F.substring(t, 1, 1))
    left = nodes.where(F.exists("first_t", lambda t: F.octet_length(t) == 1))
    left = left.select(*block, *_side_columns(nodes, "l", attrs), shape.alias("_shape"))
    right = nodes.select(*block, *_side_columns(nodes, "r", attrs), shape.alias("_shape"))
    return left.join(right, [*block, "_shape"]).where("l_rep <> r_rep").drop("_shape")


def _first_name_pairs(nodes: DataFrame, block: list[str], attrs: list[str]) -> DataFrame:
    """Node pairs of a block whose first names match (P6), each in one order at least."""
    found = _subset_candidates(nodes, block, "first_t", attrs).unionByName(_initials_candidates(nodes, block, attrs))
    return found.where(P.first_names_match(F.col("l_first_t"), F.col("r_first_t")))


def _swap_candidates(nodes: DataFrame, block: list[str], attrs: list[str]) -> DataFrame:
    """Node pairs of a block that the swapped-name rule links, left as ``a`` and right as ``b``.

    The rule needs a token that is a last name on the left and a first name on the right. All of
    a block share the leading first name. If that is the token, the left side has it among its own
    last names, which few records do. Else the right side has the token as a further first name; where the
    block shares the leading last name too, it has that one among its own first names: the left's last names
    are all first names on the right, or the other way round.
    """
    l = {"first_t": F.col("l_first_t"), "last_t": F.col("l_last_t")}
    r = {"first_t": F.col("r_first_t"), "last_t": F.col("r_last_t")}
    every = {side: nodes.select(*block, *_side_columns(nodes, side, attrs)) for side in ("l", "r")}

    def some(side: str, condition: Column) -> DataFrame:
        return _held(nodes.where(condition).select(*block, *_side_columns(nodes, side, attrs)))[0]

    lead = some("l", F.array_contains("last_t", F.col("first_t")[0]))
    found = [every["r"].join(lead, block)]
    if "last0" in block:
        found.append(every["l"].join(some("r", F.array_contains("first_t", F.col("last_t")[0])), block))
    else:
        further = F.array_remove(F.array_distinct("first_t"), F.col("first_t")[0])
        right = nodes.where(F.size(further) > 0).select(*block, *_side_columns(nodes, "r", attrs), F.explode(further).alias("_token"))
        left = nodes.select(*block, *_side_columns(nodes, "l", attrs), F.explode(F.array_distinct("last_t")).alias("_token"))
        # further first names are few words; last names that are none of them need no shuffle
        tokens, n = _held(right.select("_token").distinct())
        if n <= BROADCAST_ROWS:
            left = left.join(tokens, "_token", "left_semi")
        found.append(left.join(right, [*block, "_token"]))
    pairs = None
    for part in found:
        part = part.where((F.col("l_rep") != F.col("r_rep")) & _r3(l, r)).select(*CANDIDATE)
        pairs = part if pairs is None else pairs.unionByName(part)
    return pairs.select(*CANDIDATE, F.lit(True).alias("fwd"), F.lit(False).alias("bwd")).distinct()


def _edge(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("l_rep").alias("src"), F.col("r_rep").alias("dst"))


def _sides(prefix: str, fixed: dict[str, Column] | None = None) -> dict[str, Column]:
    cols = {c: F.col(f"{prefix}{c}") for c in FEATURE_COLUMNS}
    if fixed:
        cols.update(fixed)
    return cols


def _member_edges(features: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """Star edges member -> node representative for the given node table."""
    return (features.join(nodes.select(*key, "rep"), on=key, how="inner")
            .where(F.col("person_id") != F.col("rep"))
            .select(F.col("person_id").alias("src"), F.col("rep").alias("dst")))


def email_edges(features: DataFrame) -> DataFrame:
    """J1 + P5: e-mail edges, shared-mailbox couples excluded, no per-mailbox square."""
    mail = features.where(F.col("email_n") != "")
    full_address = (F.col("street_n") != "") & (F.col("city_main") != "")
    address_class = F.when(full_address, F.struct("campus_id", "street_n", "city_main"))
    groups = (mail.groupBy("email_n")
              .agg(F.min("person_id").alias("gmin"),
                   F.count(F.lit(1)).alias("gsize"),
                   F.count_distinct(address_class).alias("n_classes"),
                   F.max((~full_address).cast("int")).alias("has_open")))
    connected = groups.where((F.col("gsize") >= 2) & ((F.col("n_classes") >= 2) | (F.col("has_open") == 1)))
    star = _member_edges(mail, connected.select("email_n", F.col("gmin").alias("rep")), ["email_n"])

    # Single-address mailboxes: campus, street and city main are shared, so a
    # pair is a couple iff the suffixes are compatible and first names differ.
    closed = groups.where((F.col("gsize") >= 2) & (F.col("n_classes") == 1) & (F.col("has_open") == 0)).select("email_n")
    members = _kept(mail.join(closed, "email_n", "left_semi").select("person_id", "email_n", "city_by", "first_t"))
    # Incompatible suffixes link everyone of both suffix classes; a class with such a
    # counterpart is one component through its representative.
    classes = members.groupBy("email_n", "city_by").agg(F.min("person_id").alias("rep"))
    apart = _pairs_within(classes, ["email_n"], ["rep", "city_by"]).where(
        ~P.suffix_compatible(F.col("l_city_by"), F.col("r_city_by")))
    ends = apart.select(F.col("l_rep").alias("rep")).union(apart.select(F.col("r_rep").alias("rep"))).distinct()
    class_star = _member_edges(members, classes.join(ends, "rep", "left_semi"), ["email_n", "city_by"])
    # Else first names decide.
    key = ["email_n", "city_by", "first_t"]
    nodes = members.groupBy(*key).agg(F.min("person_id").alias("rep"))
    pairs = _first_name_pairs(nodes, ["email_n"], ["rep", "first_t"])
    # A node is internally linked when it has first names (a node with blank
    # first names is a couple with itself).
    node_star = _member_edges(members, nodes.where(F.size("first_t") > 0), key)
    out = star
    for part in (_edge(apart), class_star, _edge(pairs), node_star):
        out = out.unionByName(part)
    return out


def _r1(l: dict, r: dict) -> Column:
    return (P.city_equal(l["city_main"], l["city_by"], r["city_main"], r["city_by"])
            & (l["street_n"] != "") & (l["street_n"] == r["street_n"])
            & P.first_names_match(l["first_t"], r["first_t"]))


def _r2(l: dict, r: dict) -> Column:
    return P.first_names_match(l["first_t"], r["first_t"]) & P.last_names_match(l["last_t"], r["last_t"])


def _r3(a: dict, b: dict) -> Column:
    return P.first_names_match(a["first_t"], b["last_t"]) & P.last_names_match(a["last_t"], b["first_t"])


def _swapped_edges(features: DataFrame, nodes: DataFrame, candidates: DataFrame, node_key: list[str]) -> DataFrame:
    """Edges for node pairs that only the swapped-name rule can link.

    ``candidates`` holds ``CANDIDATE`` and ``fwd`` (rule holds with the left node as
    ``a``, whose id is the smaller) / ``bwd``. A pair of members is a couple, and not
    linked, only inside one class of mailbox, campus, street and city. If some pair in
    id order crosses classes, so does one of the ends: smallest id (or smallest of
    another class) on the left, largest on the right. Only members of such nodes are looked at.
    """
    candidates = _kept(candidates)
    reps = candidates.select(F.col("l_rep").alias("rep")).union(candidates.select(F.col("r_rep").alias("rep"))).distinct()
    met, n = _held(nodes.join(reps, "rep", "left_semi").select(*node_key))
    if n == 0:
        return candidates.select(F.col("l_rep").alias("src"), F.col("r_rep").alias("dst"))
    features = features.join(met, node_key, "left_semi")
    closed = (F.col("email_n") != "") & (F.col("street_n") != "") & (F.col("city_main") != "")
    held = features.withColumn("cls", F.when(closed, F.struct("email_n", "campus_id", "street_n", "city_main")))
    by_class = held.groupBy(*node_key, "cls").agg(F.min("person_id").alias("lo"), F.max("person_id").alias("hi"))
    ends = by_class.groupBy(*node_key).agg(F.min(F.struct("lo", "cls")).alias("low"), F.max(F.struct("hi", "cls")).alias("high"))
    other = by_class.join(ends, node_key).groupBy(*node_key, "low", "high").agg(
        F.min(F.when(~F.col("cls").eqNullSafe(F.col("low.cls")), F.col("lo"))).alias("low2"),
        F.max(F.when(~F.col("cls").eqNullSafe(F.col("high.cls")), F.col("hi"))).alias("high2"))
    side = other.withColumn("rep", F.col("low.lo"))
    names = ["rep", "first_t", "last_t"]
    for s in ("l", "r"):
        candidates = candidates.join(side.select(*[F.col(c).alias(f"{s}_{c}") for c in [*names, "low", "high", "low2", "high2"]]),
                                     [f"{s}_{c}" for c in names])
    no_couple = P.first_names_match(F.col("l_first_t"), F.col("r_first_t"))

    def in_order(a: str, b: str) -> Column:
        return F.col(f"{a}_low.lo") < F.col(f"{b}_high.hi")

    def crosses(a: str, b: str) -> Column:
        apart = ~F.coalesce(F.col(f"{a}_low.cls") == F.col(f"{b}_high.cls"), F.lit(False))
        second = (F.col(f"{a}_low2") < F.col(f"{b}_high.hi")) | (F.col(f"{a}_low.lo") < F.col(f"{b}_high2"))
        return in_order(a, b) & (no_couple | apart | F.coalesce(second, F.lit(False)))

    fwd, bwd = F.col("fwd") & crosses("l", "r"), F.col("bwd") & crosses("r", "l")
    linked = candidates.where(fwd | bwd).select(F.col("l_rep").alias("src"), F.col("r_rep").alias("dst"))

    # All members in one class: they are no couple where their city suffixes exclude each other.
    left = (F.col("fwd") & in_order("l", "r")) | (F.col("bwd") & in_order("r", "l"))
    rest = candidates.where(~(fwd | bwd) & left).withColumn("cls", F.when(F.col("fwd") & in_order("l", "r"), F.col("l_low.cls")).otherwise(F.col("r_low.cls")))
    suffixes = held.where("cls IS NOT NULL").groupBy(*node_key, "cls", F.col("city_by").alias("by")).agg(
        F.min("person_id").alias("lo"), F.max("person_id").alias("hi"))
    suffixes = suffixes.join(ends.select(*node_key, F.col("low.lo").alias("rep")), node_key)
    for s in ("l", "r"):
        rest = rest.join(suffixes.select("cls", *[F.col(c).alias(f"{s}_{c}") for c in [*names, "by", "lo", "hi"]]),
                         ["cls", *[f"{s}_{c}" for c in names]])
    apart = ~P.suffix_compatible(F.col("l_by"), F.col("r_by"))
    ordered = (F.col("fwd") & (F.col("l_lo") < F.col("r_hi"))) | (F.col("bwd") & (F.col("r_lo") < F.col("l_hi")))
    more = rest.where(apart & ordered).select(F.col("l_rep").alias("src"), F.col("r_rep").alias("dst"))
    return linked.unionByName(more).distinct()


def block_edges(features: DataFrame) -> DataFrame:
    """J2 + P4: pairs sharing a blocking key that match, as node-level edges."""
    out = []
    # fcs blocks: same first token, city main and street. R1 reads no last name, so
    # its nodes are (suffix, first names).
    people = features.where((F.size("first_t") > 0) & (F.col("city_main") != "") & (F.col("street_n") != ""))
    block = ["first0", "city_main", "street_n"]
    key = [*block, "city_by", "first_t"]
    nodes = _kept(people.groupBy(*key).agg(F.min("person_id").alias("rep")))
    out.append(_member_edges(people, nodes, key))
    compatible = P.suffix_compatible(F.col("l_city_by"), F.col("r_city_by"))
    out.append(_edge(_first_name_pairs(nodes, block, ["rep", "city_by", "first_t"]).where(compatible)))
    # R2 adds pairs whose suffixes are incompatible, R3 those with swapped names.
    key = [*key, "last_t"]
    attrs = ["rep", "city_by", "first_t", "last_t"]
    nodes = _kept(people.where(F.size("last_t") > 0).groupBy(*key).agg(F.min("person_id").alias("rep")))
    l = {"first_t": F.col("l_first_t"), "last_t": F.col("l_last_t")}
    r = {"first_t": F.col("r_first_t"), "last_t": F.col("r_last_t")}
    out.append(_edge(_subset_candidates(nodes, block, "last_t", attrs, rarest=True).where(~compatible & _r2(l, r))))
    out.append(_swapped_edges(people, nodes, _swap_candidates(nodes, block, attrs), key))

    # fl blocks: same first token and last token; a node is one full name.
    people = features.where((F.size("first_t") > 0) & (F.size("last_t") > 0))
    key, attrs = ["first_t", "last_t"], ["rep", "first_t", "last_t"]
    nodes = _kept(people.groupBy(*key).agg(F.min("person_id").alias("rep"))
                    .withColumn("first0", F.col("first_t")[0]).withColumn("last0", F.col("last_t")[0]))
    out.append(_member_edges(people, nodes, key))
    same_last = nodes.withColumn("whole_last", F.col("last_t"))
    out.append(_edge(_first_name_pairs(same_last, ["first0", "whole_last"], attrs)))
    part_of_last = _subset_candidates(nodes, ["first0", "last0"], "last_t", attrs)
    out.append(_edge(part_of_last.where((F.col("l_last_t") != F.col("r_last_t")) & _r2(l, r))))
    out.append(_swapped_edges(people, nodes, _swap_candidates(nodes, ["first0", "last0"], attrs), key))

    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def _two_part_pairs(left: DataFrame, right: DataFrame, block: list[str], first: tuple[str, str, bool],
                    second: tuple[str, str, bool] | None = None) -> DataFrame:
    """Pairs of a block that agree in two name parts, each as equal, a subset or (if flagged) by initials.

    ``first`` and ``second``: token columns of the left and of the right side, and whether
    initials count. For each part either side may be the smaller one and asks with one of
    its tokens, the other stands under all of its own; initials meet by their letters. Both
    parts are asked at once, so that a token which a whole block shares costs nothing.
    """
    def keys(side: int, part: tuple[str, str, bool] | None) -> list[Column]:
        """Key lists of one side for: left asks, right asks, initials (left has one), initials (right has one)."""
        if part is None:
            return [F.array(F.lit(""))]
        tokens = F.col(part[side])
        one, every = F.array(_asked(tokens)), F.array_distinct(tokens)
        shape = F.array(F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), " "))
        short = F.when(F.exists(tokens, lambda t: F.octet_length(t) == 1), shape)
        asks = [one, every] if side == 0 else [every, one]
        return asks + ([short, shape] if side == 0 else [shape, short]) if part[2] else asks

    def keyed(df: DataFrame, side: int) -> DataFrame:
        made = []
        for i, x in enumerate(keys(side, first)):
            for j, y in enumerate(keys(side, second)):
                both = F.flatten(F.transform(x, lambda a: F.transform(y, lambda b: F.struct(a.alias("a"), b.alias("b")))))
                made.append(F.coalesce(F.transform(both, lambda k: F.struct(F.lit(i * 4 + j).alias("how"), k["a"].alias("a"), k["b"].alias("b"))),
                                       F.expr("cast(array() as array<struct<how:int,a:string,b:string>>)")))
        return df.withColumn("_key", F.explode(F.array_distinct(F.concat(*made))))

    return keyed(left, 0).join(keyed(right, 1), [*block, "_key"]).drop("_key").distinct()


def swapped_block_edges(features: DataFrame) -> DataFrame:
    """The optional block of records whose first and last name tokens are exchanged.

    Only pairs that no other block holds are looked at: the leading tokens are exchanged
    and differ. Names meet as nodes of their own, addresses only for the address rule, so
    that the edges follow the number of names.
    """
    people = (features.where((F.size("first_t") > 0) & (F.size("last_t") > 0)).withColumn("f", F.col("first_t")[0])
              .withColumn("l", F.col("last_t")[0]).where("f <> l"))

    def sides(nodes: DataFrame, block: list[str], attrs: list[str]) -> tuple[DataFrame, DataFrame]:
        """Each pair of nodes with exchanged leading tokens once; ``f, l`` are those of the left side."""
        left = nodes.where("f < l").select("f", "l", *block, *_side_columns(nodes, "l", attrs))
        right = nodes.where("f > l").select(F.col("l").alias("f"), F.col("f").alias("l"), *block, *_side_columns(nodes, "r", attrs))
        return left, right

    l = {"first_t": F.col("l_first_t"), "last_t": F.col("l_last_t")}
    r = {"first_t": F.col("r_first_t"), "last_t": F.col("r_last_t")}
    key, attrs = ["first_t", "last_t"], ["rep", "first_t", "last_t"]
    names = people.groupBy(*key, "f", "l").agg(F.min("person_id").alias("rep"))
    both = sides(names, [], attrs)
    same = _two_part_pairs(*both, ["f", "l"], ("l_first_t", "r_first_t", True), ("l_last_t", "r_last_t", False)).where(_r2(l, r))
    swapped = _two_part_pairs(*both, ["f", "l"], ("l_first_t", "r_last_t", True), ("l_last_t", "r_first_t", True))
    swapped = swapped.select(*CANDIDATE, _r3(l, r).alias("fwd"), _r3(r, l).alias("bwd")).where("fwd OR bwd")

    # one address and first names that match in another order
    at = people.where("city_main <> '' AND street_n <> ''")
    nodes = at.groupBy("first_t", "f", "l", "city_main", "street_n", "city_by").agg(F.min("person_id").alias("rep"))
    place = ["city_main", "street_n"]
    near = _two_part_pairs(*sides(nodes, place, ["rep", "first_t", "city_by"]), ["f", "l", *place], ("l_first_t", "r_first_t", True))
    near = near.where(P.first_names_match(F.col("l_first_t"), F.col("r_first_t")) & P.suffix_compatible(F.col("l_city_by"), F.col("r_city_by")))
    return _edge(same).unionByName(_edge(near)).unionByName(_swapped_edges(people, names, swapped, key))


def linking_edges(persons: DataFrame, swap_keys: bool = False) -> DataFrame:
    """The edges of ``match_edges`` in either order, some more than once."""
    features = written_features(persons)
    edges = email_edges(features).unionByName(block_edges(features))
    if swap_keys:
        edges = edges.unionByName(swapped_block_edges(features))
    return edges


def match_edges(persons: DataFrame, swap_keys: bool = False) -> DataFrame:
    """E-mail edges united with block edges, as distinct ``(src < dst)`` pairs.

    ``swap_keys`` adds the block of exchanged first and last names.
    """
    return (linking_edges(persons, swap_keys).where(F.col("src") != F.col("dst"))
            .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
            .distinct())
