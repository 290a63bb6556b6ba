"""Cleaning: a rule set becomes one projection and one filter.

Rules are ``{"global": {rule: True}, "columns": {column: {"action": name}}}``.
Table rules run first, then each column's action in the order given; a row that
one action drops is not counted by the actions after it.

``by`` names columns that tell tables apart which are cleaned together: duplicates are sought and
statistics taken in each of them for itself, in the same passes however many there are.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import dates, derive, numbers, text
from ..operators import dedupe, group_ranks, histogram
from ..operators.cells import measure, storage_types
from ..operators.ranks import Stats, long_numbers, statistics
from ..session import stage
from .profile import Report, analyze

MEAN_ACTIONS = ("fill_missing_mean",)
MEDIAN_ACTIONS = ("fill_missing_median",)
MODE_ACTIONS = ("fill_missing_mode",)
BAND_ACTIONS = ("cap_outliers", "drop_outliers")
CASES = {"standardize_lower": F.lower, "standardize_upper": F.upper, "standardize_title": text.title}
FILLS = {"fill_missing_zero": "0", "fill_missing_unknown": "Unknown"}


def cents_text(x: float) -> str:
    """Text of a float rounded half up to cents, after ten places: what arithmetic leaves in the
    last digits of a bound that ends on half a cent (-33113.904999999984) doesn't turn it."""
    try:
        return repr(float(Decimal(round(x * 1e10)).scaleb(-10).quantize(Decimal("0.01"), ROUND_HALF_UP)))
    except (ArithmeticError, ValueError):  # too large to have cents, or no number
        return repr(x)


@dataclass(frozen=True)
class ColumnFacts:
    """What fills and caps need to know about a column, as texts and bounds; as columns
    of the rows, NULL where there is none, if they differ between tables."""

    mean: str | Column | None = None
    median: str | Column | None = None
    mode: str | Column | None = None
    band: tuple[float, float] | tuple[Column, Column] | None = None


@dataclass(frozen=True)
class Effect:
    """One action on one column: the new value, when the row is dropped, when
    the change log counts it and under what name."""

    value: Column
    counted: Column
    change: str
    drops: bool = False


class Cell:
    """A column and what its action asks about it.  Each answer is a helper
    column, worked out once per row however often the action refers to it."""

    def __init__(self, name: str, at: int, free: str = "_"):
        self.raw, self.at, self.free, self.helpers = text.quoted(name), at, free, {}

    def _helper(self, kind: str, expr: Column) -> Column:
        self.helpers[f"{self.free}{kind}{self.at}"] = expr
        return F.col(f"{self.free}{kind}{self.at}")

    @property
    def stripped(self) -> Column:
        return self._helper("s", text.strip(self.raw))

    @property
    def blank(self) -> Column:
        return self._helper("b", text.is_blank(self.raw))

    @property
    def number(self) -> Column:
        return self._helper("x", numbers.number(self.raw))

    @property
    def day(self) -> Column:
        return self._helper("d", dates.tagged_day(dates.tagged_date(text.strip(self.raw))))

    @property
    def bad_email(self) -> Column:
        return self._helper("e", ~text.is_blank(self.raw) & ~text.is_email(self.raw))


def effect(action: str, cell: Cell, facts: ColumnFacts, as_of: str) -> Effect | None:
    """Effect of an action on a column, or None if it changes nothing."""
    v = cell.raw

    def when(condition, value, change):
        return Effect(F.when(condition, value).otherwise(v), condition, change)

    def drop(condition):
        return Effect(v, condition, "rows_dropped", drops=True)

    def fill(value):
        if isinstance(value, Column):
            return when(cell.blank & value.isNotNull(), value, "filled")
        return None if value is None else when(cell.blank, F.lit(value), "filled")

    def cents(bound):
        return numbers.cents_text(bound) if isinstance(bound, Column) else F.lit(cents_text(bound))

    def known(condition):
        return F.coalesce(condition, F.lit(False))

    null = F.lit(None).cast("string")
    if action == "trim_whitespace":
        return when(known(v != cell.stripped), cell.stripped, "trimmed")
    if action in CASES:
        return when(~cell.blank, CASES[action](cell.stripped), "case_normalized")
    if action == "standardize_date_iso":
        return Effect(F.coalesce(cell.day, v), known(cell.day != cell.stripped), "dates_normalized")
    if action in FILLS:
        return fill(FILLS[action])
    if action == "fill_missing_mean":
        return fill(facts.mean)
    if action == "fill_missing_median":
        return fill(facts.median)
    if action == "fill_missing_mode":
        return fill(facts.mode)
    if action == "fill_missing_today":
        return fill(as_of)
    if action == "drop_rows_missing":
        return drop(cell.blank)
    if action == "drop_rows_invalid_email":
        return drop(cell.bad_email)
    if action == "null_invalid_email":
        return when(cell.bad_email, null, "nulled")
    if action in BAND_ACTIONS and facts.band is not None:
        low, high = facts.band
        under, over = known(cell.number < low), known(cell.number > high)
        if action == "drop_outliers":
            return drop(under | over)
        capped = F.when(under, cents(low)).when(over, cents(high)).otherwise(v)
        return Effect(capped, under | over, "capped")
    if action == "abs_values":
        return when(known(cell.number < 0), numbers.abs_text(v, cell.number), "abs_applied")
    if action == "drop_rows_negative":
        return drop(known(cell.number < 0))
    if action == "null_negative":
        return when(known(cell.number < 0), null, "nulled")
    return None  # keep_missing, keep_outliers and unknown actions


def deduplicate(df: DataFrame, cols: list[str], seq: str, rules: dict, key: str | None, by: list[str] = ()) -> DataFrame:
    """Table rules: full duplicates, near duplicates, key duplicates."""
    if rules.get("remove_near_duplicates"):
        # The first row of a near-duplicate group is the first of its exact
        # copies too, so this also removes full duplicates.
        df = dedupe.drop_near_duplicates(df, cols, seq, by)
    elif rules.get("remove_full_duplicates"):
        df = dedupe.drop_full_duplicates(df, cols, seq, by)
    if rules.get("dedupe_by_pk") and key:
        df = dedupe.drop_key_duplicates(df, key, seq, by)
    return df


def column_facts(df: DataFrame, actions: dict[str, str], seq: str) -> dict[str, ColumnFacts]:
    """Statistics the actions ask for, and no others."""
    mean = [c for c, a in actions.items() if a in MEAN_ACTIONS]
    median = [c for c, a in actions.items() if a in MEDIAN_ACTIONS]
    mode = [c for c, a in actions.items() if a in MODE_ACTIONS]
    band = [c for c, a in actions.items() if a in BAND_ACTIONS]
    needed = list(dict.fromkeys(mean + median + mode + band))
    if not needed:
        return {}
    stats: dict[str, Stats] = {}
    numeric = list(dict.fromkeys(mean + median + band))
    if numeric:
        parsed = long_numbers(df, {c: numbers.number(text.quoted(c)) for c in numeric})
        values = stage(parsed, "numbers")
        stats = statistics(values, median=bool(median), quartiles=bool(band))
    stats = {c: stats.get(c, Stats()) for c in needed}
    texts = median_texts(df, {c: stats[c].median for c in median})
    common = {r["column_name"]: r["mode"] for r in histogram.modes(df, mode, seq).collect()} if mode else {}
    return {
        c: ColumnFacts(
            mean=cents_text(stats[c].mean) if c in mean and stats[c].n else None,
            median=texts.get(c), mode=common.get(c), band=stats[c].band if c in band else None)
        for c in needed
    }


EXACT = 2 ** 53  # doubles from here on stand for several whole numbers


def median_texts(df: DataFrame, medians: dict[str, float | None]) -> dict[str, str]:
    """Median as text: whole if it is written whole somewhere in the column."""
    medians = {c: m for c, m in medians.items() if m is not None}
    if not medians:
        return {}
    whole = lambda c, m: F.bool_or((numbers.number(text.quoted(c)) == m) & ~F.contains(text.quoted(c), F.lit(".")))
    row = df.agg(*[whole(c, m).alias(f"w{i}") for i, (c, m) in enumerate(medians.items())]).first()
    return {c: (str(int(m)) if abs(m) < EXACT else _whole_median(df, c, m)) if row[f"w{i}"] else repr(m)
            for i, (c, m) in enumerate(medians.items())}


def _whole_median(df: DataFrame, c: str, m: float) -> str:
    """Digits of the upper median among the whole numbers that are read as ``m``:
    those below are counted, the rest told apart by length and digits."""
    x = numbers.number(text.quoted(c))
    counts = df.agg(F.count(x).alias("n"), F.count_if(x < m).alias("below")).first()
    cell = text.quoted(c)
    digits = F.when(F.contains(cell, F.lit(".")), F.lit(str(abs(int(m))))).otherwise(numbers.whole_text(cell))
    same = stage(df.filter(x == m).groupBy(digits.alias("digits")).agg(F.count("*").alias("n")), "digits")
    return ("-" if m < 0 else "") + _digits_at(same, counts["n"] // 2 - counts["below"], m > 0)


RADIX = 4  # digits told apart in one pass, so that at most 10,000 counts come back


def _digits_at(values: DataFrame, k: int, rising: bool) -> str:
    """The k-th (from 0) of the whole numbers in ``values`` (digits without leading zeros, n
    times each), by radix selection: first the length is found that holds it, then its
    digits, a few in each pass.  No task orders numbers."""
    def narrowed(rows: DataFrame, part: Column, k: int):
        counts = rows.groupBy(part.alias("part")).agg(F.sum("n").alias("n")).collect()
        for r in sorted(counts, key=lambda r: r["part"], reverse=not rising):
            if k < r["n"]:
                return r["part"], k
            k -= r["n"]
        raise ValueError("There are fewer numbers.")

    length, k = narrowed(values, F.length("digits"), k)
    values, found = values.filter(F.length("digits") == length), ""
    while len(found) < length:
        part, k = narrowed(values.filter(F.startswith("digits", F.lit(found))), F.substring("digits", len(found) + 1, RADIX), k)
        found += part
    return found


def group_facts(df: DataFrame, actions: dict[str, str], seq: str, by: list[str], free: str) -> tuple[DataFrame, dict[str, ColumnFacts]]:
    """Statistics that the actions ask for in every group: a stored table with a row for each
    group, and for each column the columns of that table.  A median from 2^53 on is written as
    the double it is.  ``df`` is read several times."""
    given, by = by, [f"{free}g{i}" for i in range(len(by))]  # names that no statistic has
    df = df.withColumnsRenamed(dict(zip(given, by)))
    of_group = [text.quoted(b) for b in by]
    asked = {kind: [c for c, a in actions.items() if a in of] for kind, of in (
        ("mean", MEAN_ACTIONS), ("median", MEDIAN_ACTIONS), ("mode", MODE_ACTIONS), ("band", BAND_ACTIONS))}
    numeric = list(dict.fromkeys(asked["mean"] + asked["median"] + asked["band"]))
    groups = df.select(*of_group).distinct()
    name = lambda what, c: f"{free}{what}{list(actions).index(c)}"
    if numeric:
        entries = [F.struct(F.lit(c).alias("name"), numbers.number(text.quoted(c)).alias("x")) for c in numeric]
        cells = df.select(*of_group, F.inline(F.array(*entries)), F.lit(1).cast("bigint").alias("n"))
        values = stage(cells.filter(F.col("x").isNotNull()), "numbers")
        stats = group_ranks.statistics(values, by, bool(asked["median"]), bool(asked["band"]))
        reach = F.col("q3") - F.col("q1")
        low, high = F.when(reach > 0, F.col("q1") - 1.5 * reach), F.when(reach > 0, F.col("q3") + 1.5 * reach)
        of = lambda c, x: F.max(F.when(F.col("name") == c, x))
        found = [of(c, numbers.cents_text(F.col("mean"))).alias(name("mean", c)) for c in asked["mean"]]
        found += [of(c, F.col("median")).alias(name("median", c)) for c in asked["median"]]
        found += [of(c, x).alias(name(w, c)) for c in asked["band"] for w, x in (("low", low), ("high", high))]
        groups = group_ranks.joined(groups, stats.groupBy(*of_group).agg(*found), by, "left")
    if asked["median"]:
        # whole if it is written whole somewhere in the group
        def written(c):
            same = numbers.number(text.quoted(c)) == F.col(name("median", c))
            return F.coalesce(F.bool_or(same & ~F.contains(text.quoted(c), F.lit("."))), F.lit(False)).alias(name("whole", c))

        groups = stage(groups, "groups")
        medians = groups.select(*of_group, *[name("median", c) for c in asked["median"]])
        whole = group_ranks.joined(df, medians, by).groupBy(*of_group).agg(*[written(c) for c in asked["median"]])
        m = lambda c: F.col(name("median", c))
        groups = group_ranks.joined(groups, whole, by, "left").withColumns({
            name("median", c): F.when(F.col(name("whole", c)), F.coalesce(m(c).try_cast("decimal(38,0)").cast("string"), numbers.float_text(m(c))))
            .otherwise(numbers.float_text(m(c))) for c in asked["median"]})
    if asked["mode"]:
        entries = [F.struct(F.lit(c).alias("name"), text.quoted(c).alias("value")) for c in asked["mode"]]
        cells = df.select(*of_group, text.quoted(seq).alias(f"{free}seq"), F.inline(F.array(*entries)))
        counts = cells.filter(~text.is_blank(F.col("value"))).groupBy(*of_group, "name", "value").agg(
            F.count("*").alias("n"), F.min(f"{free}seq").alias("first"))
        best = lambda c: F.min(F.when(F.col("name") == c, F.struct((-F.col("n")).alias("n"), F.col("first"), F.col("value"))))
        modes = counts.groupBy(*of_group).agg(*[best(c)["value"].alias(name("mode", c)) for c in asked["mode"]])
        groups = group_ranks.joined(groups, modes, by, "left")
    column = lambda what, c: F.col(name(what, c)) if c in asked[what] else None
    facts = {c: ColumnFacts(column("mean", c), column("median", c), column("mode", c),
                            (F.col(name("low", c)), F.col(name("high", c))) if c in asked["band"] else None)
             for c in dict.fromkeys(numeric + asked["mode"])}
    return stage(groups.withColumnsRenamed(dict(zip(by, given))), "group-facts"), facts


def stored_types(df: DataFrame, cols: list[str], seq: str) -> dict[str, str]:
    """Type that each column of cleaned rows is stored in: the one its leading cells suggest,
    or the next wider of INTEGER, REAL and TEXT that every cell fits, so none is lost."""
    parse = {"INTEGER": numbers.plain_int, "REAL": numbers.plain_float}
    kinds = {r["column_name"]: r["storage_type"] for r in storage_types(df, cols, seq, missing=lambda c: c.isNull()).collect()}
    asked = [(i, c) for i, c in enumerate(cols) if kinds[c] in parse]
    if not asked:
        return kinds
    fits = df.agg(*[F.bool_and(text.quoted(c).isNull() | f(text.quoted(c)).isNotNull()).alias(f"{kind}{i}")
                    for i, c in asked for kind, f in parse.items()]).first()
    wider = {"INTEGER": ["INTEGER", "REAL"], "REAL": ["REAL"]}
    return kinds | {c: next((k for k in wider[kinds[c]] if fits[f"{k}{i}"]), "TEXT") for i, c in asked}


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The columns in their stored types."""
    parse = {"INTEGER": numbers.plain_int, "REAL": numbers.plain_float}
    return df.withColumns({c: parse[k](text.quoted(c)) for c, k in kinds.items() if k in parse})


@dataclass
class Cleaned:
    """A cleaning as lazy plans over the same marked rows."""

    source: DataFrame
    marked: DataFrame  # seq, new cells, _quality_flag, <free>dropped_by, <free>c<i>
    cols: list[str]
    seq: str
    effects: list[tuple[str, Effect]]
    free: str  # what the names of helper columns begin with
    by: tuple[str, ...] = ()

    @property
    def _by(self) -> list[Column]:
        return [text.quoted(b) for b in self.by]

    @property
    def dropped_by(self) -> Column:
        return F.col(f"{self.free}dropped_by")

    @property
    def data(self) -> DataFrame:
        """Cleaned rows; blank cells are NULL."""
        return self.marked.filter(self.dropped_by.isNull()).select(
            *self._by, text.quoted(self.seq), *[text.quoted(c) for c in self.cols], "_quality_flag")

    def _counts(self) -> list[Column]:
        kept = self.dropped_by.isNull()
        return [
            F.count_if(F.col(f"{self.free}c{i}") & ((self.dropped_by == i) if e.drops else
                                                    (kept | (self.dropped_by > i)))).alias(f"_n{i}")
            for i, (_, e) in enumerate(self.effects)
        ]

    def change_log(self) -> DataFrame:
        """column_name, change, n, after the columns of ``by``; changes that happened."""
        schema = "column_name string, change string, n bigint"
        if not self.effects:
            none = self.source.select(*self._by).limit(0)
            return none.crossJoin(self.source.sparkSession.createDataFrame([], schema)) if self.by else (
                self.source.sparkSession.createDataFrame([], schema))
        row = self.marked.groupBy(*self._by).agg(*self._counts())
        entries = [F.struct(F.lit(c).alias("column_name"), F.lit(e.change).alias("change"), F.col(f"_n{i}").alias("n"))
                   for i, (c, e) in enumerate(self.effects)]
        return row.select(*self._by, F.inline(F.filter(F.array(*entries), lambda e: e["n"] > 0)))

    def summary(self) -> DataFrame:
        """One row: rows and blank cells before and after, POOR rows."""
        blanks = lambda test: sum((test(text.quoted(c)).cast("int") for c in self.cols), F.lit(0))
        zero = F.lit(0)
        before = self.source.select(F.lit(1).alias("a"), blanks(text.is_blank).alias("b"), zero.alias("c"),
                                    zero.alias("d"), zero.alias("e"))
        after = self.data.select(zero.alias("a"), zero.alias("b"), F.lit(1).alias("c"),
                                 blanks(lambda c: c.isNull()).alias("d"),
                                 (F.col("_quality_flag") == "POOR").cast("int").alias("e"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        return before.unionAll(after).agg(
            total("a").alias("original_rows"), total("c").alias("cleaned_rows"),
            (total("a") - total("c")).alias("rows_dropped"), total("e").alias("poor_rows"),
            total("b").alias("original_nulls"), total("d").alias("cleaned_nulls"),
            (total("b") - total("d")).alias("nulls_resolved"))

    def column_completeness(self) -> DataFrame:
        """column_name, completeness, null_count after cleaning."""
        counts = measure(self.data, self.cols, {"null_count": lambda c: F.count_if(c.isNull())}, {"total": F.count("*")})
        return counts.select("column_name", numbers.ratio(F.col("total") - F.col("null_count"), F.col("total"), 1)
                             .alias("completeness"), "null_count")

    def preview(self, k: int = 10) -> DataFrame:
        return self.data.orderBy(text.quoted(self.seq)).limit(k)

    def write(self, path: str, form: str = "parquet", **options) -> dict:
        """Write the cleaned rows and return change log and totals, observed
        while writing: one pass over the data."""
        kept = self.dropped_by.isNull()
        seen = Observation("cleaning")
        metrics = [
            F.count_if(kept).alias("cleaned_rows"),
            F.count_if(kept & (F.col("_quality_flag") == "POOR")).alias("poor_rows"),
            *[F.count_if(kept & text.quoted(c).isNull()).alias(f"_b{i}") for i, c in enumerate(self.cols)],
            *self._counts(),
        ]
        observed = self.marked.observe(seen, *metrics)
        rows = observed.filter(kept).select(*self._by, *[text.quoted(c) for c in self.cols], "_quality_flag")
        rows.write.format(form).mode("overwrite").options(**options).save(path)
        got = seen.get
        changes: dict[str, dict[str, int]] = {}
        for i, (c, e) in enumerate(self.effects):
            if got[f"_n{i}"]:
                changes.setdefault(c, {})[e.change] = got[f"_n{i}"]
        nulls = {c: got[f"_b{i}"] for i, c in enumerate(self.cols)}
        return {"cleaned_rows": got["cleaned_rows"], "poor_rows": got["poor_rows"], "changes_by_col": changes,
                "cleaned_nulls": sum(nulls.values()), "nulls_by_col": nulls}


def clean(df: DataFrame, cols: list[str], seq: str, rules: dict, key: str | None = None,
          as_of: datetime.date | str | None = None, by: list[str] = ()) -> Cleaned:
    """Apply a rule set to a table of text columns, or to the tables that ``by`` tells apart.
    The flag of an earlier cleaning is replaced."""
    as_of = str(as_of or datetime.date.today())
    cols = [c for c in cols if c.lower() != "_quality_flag"]
    free = text.free_prefix([seq, "_quality_flag", *by, *cols])
    table_rules = rules.get("global", {})
    groups = [text.quoted(b) for b in by]
    df = df.select(*groups, text.quoted(seq), *[text.quoted(c) for c in cols])
    rows = deduplicate(df, cols, seq, table_rules, key, by)
    actions = {c: r.get("action") for c, r in rules.get("columns", {}).items() if c in cols and r.get("action")}
    wanted = [c for c, a in actions.items() if a in MEAN_ACTIONS + MEDIAN_ACTIONS + MODE_ACTIONS + BAND_ACTIONS]
    facts = {}
    if wanted:
        basis = rows.select(*groups, text.quoted(seq), *[text.quoted(c) for c in wanted])
        # Statistics take several passes: deduplicate once, keeping only the
        # columns they read.
        basis = stage(basis, "basis") if any(table_rules.values()) else basis
        if by:
            of_groups, facts = group_facts(basis, {c: actions[c] for c in wanted}, seq, list(by), free)
            rows = group_ranks.joined(rows, of_groups, list(by), "left")
        else:
            facts = column_facts(basis, actions, seq)
    effects, helpers = [], {}
    for c, action in actions.items():
        cell = Cell(c, len(effects), free)
        e = effect(action, cell, facts.get(c, ColumnFacts()), as_of)
        if e is not None:
            effects.append((c, e))
            helpers.update(cell.helpers)
    rows = rows.withColumns(helpers) if helpers else rows
    new = {c: e.value for c, e in effects}
    dropped = [F.when(e.counted, F.lit(i)) for i, (_, e) in enumerate(effects) if e.drops]
    changed = rows.select(
        *groups, text.quoted(seq), *[new.get(c, text.quoted(c)).alias(c) for c in cols],
        (F.coalesce(*dropped) if dropped else F.lit(None).cast("int")).alias(f"{free}dropped_by"),
        *[e.counted.alias(f"{free}c{i}") for i, (_, e) in enumerate(effects)])
    nulled = changed.withColumns({c: F.when(~text.is_blank(text.quoted(c)), text.quoted(c)) for c in cols})
    marked = nulled.withColumn("_quality_flag", derive.quality_flag([text.quoted(c).isNull() for c in cols]))
    return Cleaned(df, marked, cols, seq, effects, free, tuple(by))


def without_idle(rules: dict, report: Report) -> dict:
    """The rules without the table rules that, by the report of the same rows, remove none."""
    idle = {"remove_full_duplicates": not report.full_duplicates, "remove_near_duplicates": not report.full_duplicates + report.near_duplicates,
            "dedupe_by_pk": True}  # the report's key has no repeats
    return rules | {"global": {r: on and not idle.get(r) for r, on in rules.get("global", {}).items()}}


def auto_clean(df: DataFrame, cols: list[str], seq: str, as_of=None) -> tuple[Report, Cleaned]:
    """Profile, choose the default rules, clean."""
    report = analyze(df, cols, seq, samples=0)
    return report, clean(df, cols, seq, without_idle(report.default_rules(), report), report.primary_key, as_of)
