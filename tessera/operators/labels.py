"""Label maps, value matching and one-to-one assignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.compare import let, levenshtein_ratio


def label_form(c: Column) -> Column:
    """lower case; colons, hashes and hyphens are blanks; single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[:#-]", " "), r"\s+", " "))


def label_map(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """By (key, value) the count; of each key the value seen most, the smaller on ties."""
    counted = pairs.groupBy(key, value).agg(F.count("*").alias("seen"))
    return counted.groupBy(key).agg(F.min_by(F.struct(value, "seen"), F.struct(-F.col("seen"), value)).alias("_b")).select(key, f"_b.{value}", "_b.seen")


def value_score(a: Column, b: Column) -> Column:
    """F09 on plain text: 1 equal, 0.95 equal digits (3 or more), 0.80 containment of half or more, else 0.85 of an
    edit ratio from 0.85 on."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    dx, dy = F.regexp_replace(x, "[^0-9]", ""), F.regexp_replace(y, "[^0-9]", "")
    shorter, longer = F.least(F.char_length(x), F.char_length(y)), F.greatest(F.char_length(x), F.char_length(y))
    ratio = levenshtein_ratio(x, y)
    return (
        F.when(x == y, 1.0)
        .when((F.char_length(dx) >= 3) & (dx == dy), 0.95)
        .when((x.contains(y) | y.contains(x)) & (shorter / longer >= 0.5), 0.80)
        .when(ratio >= 0.85, F.round(ratio * 0.85, 6))
        .otherwise(0.0)
    )


def _runs(c: str, widths: dict[int, Column]) -> Column:
    """The distinct runs of a text in each width that it has and that is wanted, as an array."""
    n = F.char_length(c)
    of = lambda w: F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: F.substr(F.col(c), i, F.lit(w)))
    return F.array_distinct(F.concat(*[F.when((n >= w) & wanted, of(w)).otherwise(F.array().cast("array<string>")) for w, wanted in widths.items()]))


def containing(inner: DataFrame, outer: DataFrame, s: str, t: str, keys: list[str], widths: tuple[int, ...], most: float) -> DataFrame:
    """keys, s, t: distinct texts s of inner with those texts t of outer that hold them and are at most so many times as
    long; texts shorter than the least width (widths from wide to narrow) are left out.

    Wherever s stands, all its runs do, so it meets t by one of them: the one that the fewest texts of outer have. What
    many texts share, as a common beginning, brings no pairs.
    """
    n, m = F.char_length(s), F.char_length(t)
    wider = dict(zip(widths, (None, *widths)))
    own = {w: F.lit(True) if wider[w] is None else n < wider[w] for w in widths}
    held = {w: F.lit(True) if wider[w] is None else m < most * wider[w] for w in widths}
    asked = inner.select(*keys, s).filter(n > 0).distinct().select(*keys, s, F.explode(_runs(s, own)).alias("_run"))
    index = outer.select(*keys, t).filter(m > 0).distinct().select(*keys, t, F.explode(_runs(t, held)).alias("_run")).hint("merge")  # its size is judged by the texts before they are taken apart, so it would be broadcast
    texts = index.groupBy(*keys, "_run").agg(F.count("*").alias("_texts")).hint("merge")
    rare = asked.join(texts, [*keys, "_run"], "left").groupBy(*keys, s).agg(F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("n"), "_run")).alias("_r"))
    rare = rare.filter("_r.n > 0").select(*keys, s, F.col("_r._run").alias("_run"))
    return rare.join(index, [*keys, "_run"]).filter((m <= most * n) & F.contains(F.col(t), F.col(s))).select(*keys, s, t)


def within_edits(left: DataFrame, right: DataFrame, group: str, wide: int = 6, narrow: int = 3) -> DataFrame:
    """group, x, y: distinct texts x of left and y of right, in a group, that may differ by k edits of k = 15 percent of
    the longer one, at least one; none that do is left out.

    k edits leave one of any k + 1 disjoint runs of x as it is, so y meets x by these: first those that the fewest texts
    of right have. There are always k + 1, as k + 1 narrow runs fit side by side. k is decided by the lengths that right has.
    """
    n, m = F.char_length("x"), F.char_length("y")
    k_of = lambda a, b: F.floor(F.greatest(a, b) * 0.15 + 1e-9).cast("int")
    near = lambda a, b: F.abs(a - b) <= F.greatest(a, b) * 0.15
    lengths = F.array(*[F.lit(r[0]) for r in right.select(m.alias("m")).distinct().collect()]).cast("array<int>")
    ks = F.array_distinct(F.transform(F.filter(lengths, lambda b: near(n, b) & (k_of(n, b) > 0)), lambda b: k_of(n, b)))
    texts = left.select(group, "x").distinct().withColumn("_ks", ks).filter(F.size("_ks") > 0)
    at = lambda w: F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: F.struct(i.alias("at"), F.lit(w).alias("w"), F.substr("x", i, F.lit(w)).alias("run")))
    every = texts.select(group, "x", "_ks", F.inline(F.concat(at(narrow), F.when(n >= wide, at(wide)).otherwise(at(narrow)))))
    index = right.select(group, "y").filter(m >= narrow).distinct().select(group, "y", F.explode(_runs("y", {w: F.lit(True) for w in (wide, narrow)})).alias("run")).hint("merge")
    counts = index.groupBy(group, "run").agg(F.count("*").alias("texts")).hint("merge")
    run = F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "w", "at", "run")
    ranked = every.join(counts, [group, "run"], "left").groupBy(group, "x", "_ks").agg(F.array_sort(F.collect_set(run)).alias("_runs"))

    def disjoint(k: Column) -> Column:
        free = lambda done, r: ~F.exists(done, lambda d: (d["at"] < r["at"] + r["w"]) & (r["at"] < d["at"] + d["w"]))
        chosen = F.aggregate("_runs", F.filter("_runs", lambda r: F.lit(False)), lambda done, r: F.when((F.size(done) <= k) & free(done, r), F.concat(done, F.array(r))).otherwise(done))
        tiles = F.transform(F.sequence(F.lit(0), k), lambda i: F.substr(F.col("x"), i * narrow + 1, F.lit(narrow)))
        return let(chosen, lambda c: F.when(F.size(c) > k, F.transform(F.filter(c, lambda r: r["texts"] > 0), lambda r: r["run"])).otherwise(tiles))

    keys = ranked.select(group, "x", F.explode("_ks").alias("_k")).join(ranked.select(group, "x", "_runs"), [group, "x"]).select(group, "x", "_k", F.explode(F.array_distinct(disjoint(F.col("_k")))).alias("run"))
    return keys.join(index, [group, "run"]).filter(near(n, m) & (k_of(n, m) == F.col("_k"))).select(group, "x", "y")


def match_candidates(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """Pairs of left (group, id, text) and right, in a group, that value_score may score over 0: group, left_id,
    right_id, left_text, right_text. No pair that scores is left out, and texts that share only what many share never meet.

    Equal digits meet by equality; a text meets one that holds it (or is equal) by its rarest run, and one within edits
    of it by disjoint runs, the rarest first.
    """
    sides = [rows.select(group, "id", "text", F.lower(F.trim("text")).alias(x)).filter(F.col(x) != "") for rows, x in ((left, "x"), (right, "y"))]
    a, b = (side.select(group, x).distinct() for side, x in zip(sides, "xy"))
    digits = lambda rows, x: rows.select(group, x, F.regexp_replace(x, "[^0-9]", "").alias("d")).filter("char_length(d) >= 3")
    both = digits(a, "x").join(digits(b, "y"), [group, "d"]).select(group, "x", "y")
    for s, t, rows, others in (("x", "y", a, b), ("y", "x", b, a)):
        both = both.unionByName(containing(rows, others, s, t, [group], (6, 3, 1), 2.0))
    both = both.unionByName(within_edits(a, b, group)).distinct()
    one = sides[0].select(group, F.col("id").alias("left_id"), F.col("text").alias("left_text"), "x")
    two = sides[1].select(group, F.col("id").alias("right_id"), F.col("text").alias("right_text"), "y")
    return one.join(both, [group, "x"]).join(two.hint("merge"), [group, "y"]).select(group, "left_id", "right_id", "left_text", "right_text")


def assign_one_to_one(candidates: DataFrame, group: str, left: str, right: str, score: str) -> DataFrame:
    """By group, the best remaining pair first; each side is used once. Order-dependent, so one group is walked
    in one task: groups are documents or pages, of bounded size."""
    fields = candidates.select(group, left, right, score)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, left, right], ascending=[False, True, True], kind="stable")
        used_left, used_right, keep = set(), set(), []
        for i, (a, b) in enumerate(zip(pdf[left].to_numpy(), pdf[right].to_numpy())):
            if a not in used_left and b not in used_right:
                used_left.add(a)
                used_right.add(b)
                keep.append(i)
        return pdf.iloc[keep]

    return fields.groupBy(group).applyInPandas(walk, fields.schema)


def with_fallback(rows: DataFrame, catalog: DataFrame, key: str, fallback: Column, value: str) -> DataFrame:
    """The catalog value of the exact key, else of the fallback key; two equi-joins."""
    exact = catalog.select(F.col(key).alias("_k1"), F.col(value).alias("_v1"))
    loose = catalog.groupBy(fallback.alias("_k2")).agg(F.min(value).alias("_v2"))
    joined = rows.join(exact, rows[key] == F.col("_k1"), "left").withColumn("_f", fallback).join(loose, F.col("_f") == F.col("_k2"), "left")
    return joined.withColumn(value, F.coalesce("_v1", "_v2")).drop("_k1", "_k2", "_v1", "_v2", "_f")


def drifted(a: DataFrame, b: DataFrame, key: str, coordinates: list[str], tolerance: float) -> DataFrame:
    """Keys whose page differs or whose largest coordinate difference is over the tolerance."""
    other = b.select(key, *[F.col(c).alias(f"_{c}") for c in ("page", *coordinates)])
    shift = F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) for c in coordinates])
    return a.join(other, key).withColumn("shift", shift).filter((F.col("page") != F.col("_page")) | (F.col("shift") > tolerance)).select(key, "shift", (F.col("page") != F.col("_page")).alias("page_differs"))


def first_pattern(rows: DataFrame, text: str, patterns: list[tuple[str, str]]) -> Column:
    """The target of the first pattern, in list order, that matches; a literal list is a when chain, not a join."""
    out = None
    for pattern, target in patterns:
        hit = F.col(text).rlike(pattern)
        out = F.when(hit, target) if out is None else out.when(hit, target)
    return out


def distinct_union(parts: list[DataFrame]) -> DataFrame:
    """U01."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def not_yet_there(new: DataFrame, existing: DataFrame, key: Column) -> DataFrame:
    """New rows whose key no existing row has; keys of new rows may repeat."""
    known = existing.select(key.alias("_k")).distinct()
    return new.withColumn("_key", key).join(known, F.col("_key") == F.col("_k"), "left_anti").drop("_key")


def key_form(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def reconcile_keys(rows: DataFrame, catalog: DataFrame, key: str, name: str) -> DataFrame:
    """The catalog name of a key: equal, else equal in normal form, else one contained in the other with a length
    ratio of 0.6 or more and five characters or more; the best tier, then the closest length, then the name.

    Of names of one normal form the lowest can win, so forms meet, not names.
    """
    a = rows.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_a", key_form(F.col(key)))
    b = catalog.select(name).filter(F.col(name).isNotNull()).distinct().withColumn("_b", key_form(F.col(name)))
    equal = a.join(b, F.col(key) == F.col(name)).select(key, F.lit(1).alias("_tier"), F.lit(0).alias("_gap"), name)
    forms = b.groupBy("_b").agg(F.min(name).alias(name))
    normal = a.join(forms, F.col("_a") == F.col("_b")).select(key, F.lit(2).alias("_tier"), F.lit(0).alias("_gap"), name)
    held = containing(a, forms, "_a", "_b", [], (8, 5), 1 / 0.6 + 1e-9).unionByName(containing(forms, a, "_b", "_a", [], (8, 5), 1 / 0.6 + 1e-9)).distinct()
    shorter, longer = F.least(F.char_length("_a"), F.char_length("_b")), F.greatest(F.char_length("_a"), F.char_length("_b"))
    held = held.filter(shorter / longer >= 0.6).join(forms, "_b").join(a, "_a").select(key, F.lit(3).alias("_tier"), F.abs(F.char_length("_a") - F.char_length("_b")).alias("_gap"), name)
    best = equal.unionByName(normal).unionByName(held).groupBy(key).agg(F.min(F.struct("_tier", "_gap", name)).alias("_m"))
    return best.select(key, F.col(f"_m.{name}").alias(name), F.col("_m._tier").alias("tier"))


def form_by_overlap(fields: DataFrame, catalog: DataFrame, doc: str, more_than: int = 10) -> DataFrame:
    """The form whose catalog shares most field names with a document, where they are more than ten."""
    shared = fields.select(doc, "field").distinct().join(catalog.select("form", "field").distinct(), "field").groupBy(doc, "form").agg(F.count("*").alias("shared"))
    best = shared.groupBy(doc).agg(F.min_by(F.struct("form", "shared"), F.struct(-F.col("shared"), "form")).alias("_m"))
    return best.select(doc, "_m.form", "_m.shared").filter(F.col("shared") > more_than)


def grouped_questions(missing: DataFrame, groups: dict[str, list[str]], doc: str, most: int = 5) -> DataFrame:
    """Missing (doc, fields array): a group is asked where two or more of its fields are missing, five at most a
    document, in the groups' order."""
    asked = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(g).alias("group"), F.size(F.array_intersect("fields", F.array(*map(F.lit, f)))).alias("missing")) for i, (g, f) in enumerate(groups.items())])
    fires = F.slice(F.filter(asked, lambda q: q["missing"] >= 2), 1, most)
    return missing.select(doc, F.inline(fires)).drop("rank")
