"""Benchmark decontamination by templates, in DataFrame functions only.

A text becomes a list of tokens.  Numbers, names and units are typed: their
tokens carry a mark and, in the template, count as the mark alone.  Windows of
``width`` template tokens are hash-joined with those of the benchmark, so a
question comes up again with other numbers or names.  A document leaks an item
when its windows cover enough of the item's and, at one alignment at least,
the slots inside matching windows are filled consistently: equal values stay
equal and different ones stay different.

An item of fewer than ``least`` tokens has no template worth a window: it is
leaked by a text, or a line of one, that has its very tokens and no others.

Names are capitalised words that follow a lower-case word, a number or a comma
on the same line; a unit is a word of ``UNITS`` right after a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import free_name, prepare, written

NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "feet", "foot", "ft", "yards", "miles", "mg", "g", "kg", "tons", "lb", "lbs", "pounds", "oz", "ml", "l", "liters", "litres", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "percent", "dollars", "cents", "euros", "mph", "kmh", "degrees", "volts", "watts")
NAMED = r"([\p{Ll}\p{N},;:] )(\p{Lu}\p{Ll}+)"
NUMERIC = r"\p{N}+(?:[.,]\p{N}+)*"
UNIT_OF = rf"({NUMBER}[^ ]+ +)({'|'.join(UNITS)})([\s\p{{P}}]|$)"
TOKEN = rf"{NUMBER}{NUMERIC}|[^\s\p{{P}}\p{{S}}{NUMBER}]+"

#: Windows of the benchmark and candidates up to here are broadcast; beyond, the joins are shuffled.
BROADCAST_ROWS = 1_000_000


def marked(text: Column) -> Column:
    """The text with marked names, numbers and units; marks that it has already are dropped."""
    t = F.translate(F.coalesce(text, F.lit("")), NAME + NUMBER + UNIT, "   ")
    for _ in range(2):  # a name right after another one is found the second time
        t = F.regexp_replace(t, NAMED, f"$1{NAME}$2")
    t = F.regexp_replace(F.lower(t), NUMERIC, f" {NUMBER}$0 ")
    return F.when(F.contains(t, F.lit(NUMBER)), F.regexp_replace(t, UNIT_OF, f"$1{UNIT}$2$3")).otherwise(t)


def tokens(mark: Column) -> Column:
    return F.regexp_extract_all(mark, F.lit(TOKEN), F.lit(0))


def template(mark: Column, raw: Column) -> Column:
    """Tokens with slots reduced to their type."""
    plain = ~(F.contains(mark, F.lit(NAME)) | F.contains(mark, F.lit(NUMBER)))
    slot = F.transform(raw, lambda x: F.when(F.substring(x, 1, 1).isin(NAME, NUMBER, UNIT), F.substring(x, 1, 1)).otherwise(x))
    return F.when(plain, raw).otherwise(slot)


def window_hashes(tokens: Column, width: int) -> Column:
    """Hash of every ``width`` consecutive tokens."""
    at = F.when(F.size(tokens) >= width, F.sequence(F.lit(1), F.size(tokens) - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(width), F.slice(tokens, i, width)))


def plain(raw: Column) -> Column:
    """Tokens without their marks, as one string."""
    return F.array_join(F.transform(raw, lambda x: F.translate(x, NAME + NUMBER + UNIT, "")), " ")


def sized(df: DataFrame) -> DataFrame:
    """Broadcast it if it has few rows by count; its rows are narrow."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 8, least: int = 4, share: float = 0.5) -> DataFrame:
    """(text_key, item_id, item_windows, matched, slots): which texts leak which items.

    ``text_key`` is ``xxhash64`` of the text, null as empty.  An item of fewer
    than ``width`` tokens is one window; one of fewer than ``least`` is found
    as a whole text or line; null items and items without tokens never are.
    Items with equal ids count apart; repeated texts are one; very long texts
    are read whole.
    """
    prepare(docs.sparkSession)
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), marked(F.col(item_text)).alias("mark"))
    items = items.withColumn("raw", tokens(F.col("mark"))).withColumn("tpl", template(F.col("mark"), F.col("raw"))).where(F.size("tpl") > 0)
    every = written(items.select("item", "item_id", "raw", "tpl", F.least(F.size("tpl"), F.lit(width)).alias("w")), "items")
    items, short = every.where(F.size("tpl") >= least), every.where(F.size("tpl") < least)
    widths = sorted(r.w for r in items.select("w").distinct().collect()) or [width]  # at most ``width`` numbers

    def exploded(df: DataFrame, keys: list[str]) -> DataFrame:
        """All windows of all widths, one width after the other, in one pass."""
        return df.select(*keys, F.size("tpl").alias("n"), F.posexplode(F.concat(*[window_hashes(F.col("tpl"), w) for w in widths])).alias("nth", "h"))

    def place(n: str, nth: str, w: Column) -> Column:
        """Where a window of width ``w`` begins: its place less the windows of smaller widths."""
        before, skipped = F.lit(0), F.lit(None).cast("int")
        for x in widths:
            skipped = F.when(w == x, before).otherwise(skipped)
            before = before + F.greatest(F.lit(0), F.col(n) - x + 1)
        return F.col(nth) - skipped

    of_items = exploded(items, ["item", "w"]).withColumn("at", place("n", "nth", F.col("w"))).where("at >= 0 and at <= n - w")
    of_items = written(of_items.select("item", "at", "h", "w"), "item-windows")
    counts = of_items.groupBy("item").agg(F.count("*").alias("item_windows"))

    base = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select(F.xxhash64("text").alias("text_key"), marked(F.col("text")).alias("mark"))
    base = base.withColumn("tpl", template(F.col("mark"), tokens(F.col("mark"))))
    hits = exploded(base, ["text_key"]).join(sized(of_items), "h").select("text_key", "item", "at", (place("n", "nth", F.col("w")) - F.col("at")).alias("shift"))
    # By alignment first: a passage that comes twice in a text counts once.
    aligned = hits.groupBy("text_key", "item", "shift", "at").count().drop("count")
    covered = aligned.groupBy("text_key", "item").agg(F.countDistinct("at").alias("matched"))
    found = covered.join(sized(counts), "item").where(F.col("matched") >= share * F.col("item_windows"))
    found = written(found.select("text_key", "item", "item_windows", "matched"), "candidates")

    # Slots: only for items that have any.
    slotted = items.where(F.exists("tpl", lambda x: x.isin(NAME, NUMBER, UNIT)))
    pairs = written(found.join(sized(slotted.select("item")), "item", "left_semi").select("text_key", "item", "item_windows"), "slot-pairs")
    if not pairs.isEmpty():
        own = written(aligned.join(sized(pairs), ["text_key", "item"]), "alignments")
        checked = slot_checks(own, docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")), slotted, width, share)
        found = found.join(checked, ["text_key", "item"], "left").where(F.coalesce("consistent", F.lit(True))).drop("consistent")
    else:
        found = found.withColumn("slots", F.lit(None).cast("int"))
    found = found.join(sized(items.select("item", "item_id")), "item").select("text_key", "item_id", "item_windows", "matched", F.coalesce("slots", F.lit(0)).alias("slots"))
    if not short.isEmpty():
        lines = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select(F.xxhash64("text").alias("text_key"), F.explode(F.array_append(F.split("text", "\n"), F.col("text"))).alias("line"))
        lines = lines.select("text_key", plain(tokens(marked(F.col("line")))).alias("p"))
        few = short.select("item_id", "item", plain(F.col("raw")).alias("p"))
        exact = lines.join(sized(few), "p").select("text_key", "item_id", "item").distinct()
        found = found.unionByName(exact.select("text_key", "item_id", F.lit(1).cast("long").alias("item_windows"), F.lit(1).cast("long").alias("matched"), F.lit(0).alias("slots")))
    return written(found, "leaks")


def alignments(own: DataFrame, width: int, share: float) -> DataFrame:
    """(text_key, item, kind, anchor, at, shift): all ways to lay an item on a text that are checked.

    0: a shift that reaches the share by itself.  1: one that does not, with
    the nearest shifts up to half the item away, as words put in or left out
    make them.  2: each window at its longest shift, for scattered pieces.
    """
    keys, shift = ["text_key", "item"], F.col("shift")
    counts = own.groupBy(*keys, "item_windows", "shift").agg(F.count("*").alias("n"))
    enough = F.col("n") >= share * F.col("item_windows")
    whole = own.join(counts.where(enough).select(*keys, "shift"), [*keys, "shift"]).select(*keys, F.lit(0).alias("kind"), shift.alias("anchor"), "at", "shift")

    reach = F.expr(f"(item_windows + {width}) div 2")
    near = F.floor(shift / reach)
    anchors = counts.where(~enough).select(*keys, shift.alias("anchor"), F.explode(F.array(near - 1, near, near + 1)).alias("near"))
    away = F.abs(shift - F.col("anchor"))
    pieces = own.withColumn("near", near).join(anchors, [*keys, "near"]).where(away <= reach)
    pieces = pieces.groupBy(*keys, "item_windows", "anchor", "at").agg(F.min_by("shift", F.struct(away.alias("away"), shift.alias("shift"))).alias("shift"))
    covering = pieces.groupBy(*keys, "item_windows", "anchor").agg(F.count("*").alias("n")).where(enough).select(*keys, "anchor")
    pieced = pieces.join(covering, [*keys, "anchor"]).select(*keys, F.lit(1).alias("kind"), "anchor", "at", "shift")

    longest = own.join(counts.select(*keys, "shift", "n"), [*keys, "shift"]).groupBy(*keys, "at").agg(F.max_by("shift", F.struct(F.col("n"), (-shift).alias("first"))).alias("shift"))
    return whole.unionByName(pieced).unionByName(longest.select(*keys, F.lit(2).alias("kind"), F.lit(0).alias("anchor"), "at", "shift"))


def slot_checks(own: DataFrame, texts: DataFrame, slotted: DataFrame, width: int, share: float) -> DataFrame:
    """(text_key, item, consistent, slots): whether any alignment fills the slots inside its matching windows consistently.

    ``own`` has the matching windows (text_key, item, shift, at, item_windows).
    """
    keys = ["text_key", "item", "kind", "anchor"]
    laid = written(alignments(own, width, share), "laid")
    spots = slotted.select("item", "w", F.posexplode("raw").alias("p", "b")).where(F.substring("b", 1, 1).isin(NAME, NUMBER, UNIT))
    spots = spots.select("item", "p", "b", F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") - F.col("w") + 1), F.col("p"))).alias("at"))
    wanted = own.select("text_key").distinct()
    filled = texts.withColumn("text_key", F.xxhash64("text")).join(sized(wanted), "text_key", "left_semi").dropDuplicates(["text_key"])
    filled = filled.select("text_key", F.posexplode(tokens(marked(F.col("text")))).alias("pos", "d")).where(F.substring("d", 1, 1).isin(NAME, NUMBER, UNIT))
    slots = laid.join(sized(spots), ["item", "at"]).select(*keys, "b", (F.col("p") + F.col("shift")).alias("pos")).distinct()
    slots = slots.join(filled, ["text_key", "pos"]).select(*keys, "b", "d").distinct()
    slots = slots.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("b").alias("n_b"), F.countDistinct("d").alias("n_d"))
    n = F.coalesce(F.col("n"), F.lit(0))
    fits = (n == F.coalesce("n_b", F.lit(0))) & (n == F.coalesce("n_d", F.lit(0)))
    judged = laid.select(*keys).distinct().join(slots, keys, "left")
    return judged.groupBy("text_key", "item").agg(F.max(fits).alias("consistent"), F.max(F.when(fits, n)).cast("int").alias("slots"))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row for each document and benchmark item that it leaks; rows of equal texts all come up.

    Null ids come back as they are; no other column is read.
    """
    found = leaks(docs, benchmark, text=text, **options)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"))
    return rows.join(sized(found), "text_key").drop("text_key")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text leaks any item; columns unchanged.

    Null and empty texts leak nothing and stay; very long ones are searched
    whole.  Null and empty items match nothing, repeated ones match once.
    Repeated rows share their fate, and ids are not looked at; columns may
    have any name.  Empty tables of either kind give ``docs`` as it is.
    """
    key = free_name(docs, "text_key")
    found = leaks(docs, benchmark, text=text, **options).select(F.col("text_key").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).join(sized(found), key, "left_anti").select(*docs.columns)


SQL = r"""
with marked as (
  select 'd' as kind, row_number() over () as no, doc_id as id, text from (select doc_id, coalesce(text, '') as text from documents)
  union all select 'b', row_number() over (), item_id, text from benchmark where text is not null
), named as (
  select kind, no, id, text, regexp_replace(regexp_replace(text, '([\p{Ll}\p{N},;:] )(\p{Lu}\p{Ll}+)', '\1' || chr(1) || '\2', 'g'), '([\p{Ll}\p{N},;:] )(\p{Lu}\p{Ll}+)', '\1' || chr(1) || '\2', 'g') as t from marked
), numbered as (
  select kind, no, id, text, regexp_replace(lower(t), '(\p{N}+(?:[.,]\p{N}+)*)', ' ' || chr(2) || '\1 ', 'g') as t from named
), measured as (
  select kind, no, id, text, regexp_replace(t, '(\x02[^ ]+ +)(@units@)([\s\p{P}]|$)', '\1' || chr(3) || '\2\3', 'g') as t from numbered
), raw as (
  select kind, no, id, text, regexp_extract_all(t, '\x02\p{N}+(?:[.,]\p{N}+)*|[^\s\p{P}\p{S}\x02]+') as raw from measured
), templates as materialized (
  select *, list_transform(raw, lambda x: case when x[1] in (chr(1), chr(2), chr(3)) then x[1] else x end) as tpl from raw
), sized as (
  select no as item, id as item_id, raw, tpl, least(len(tpl), 8) as w from templates where kind = 'b' and len(tpl) >= 4
), item_windows as materialized (
  select item, w, q, array_to_string(tpl[q + 1:q + w], ' ') as h from (select *, unnest(range(0, len(tpl) - w + 1)) as q from sized)
), widths as (select distinct w from sized
), doc_windows as (
  select no, w, pos, array_to_string(tpl[pos + 1:pos + w], ' ') as h from (select no, w, tpl, unnest(range(0, len(tpl) - w + 1)) as pos from (select * from templates where kind = 'd') d, widths where len(tpl) >= w)
), totals as (select item, count(*) as item_windows from item_windows group by 1
), aligned as materialized (
  select distinct d.no, i.item, i.q, d.pos - i.q as shift from doc_windows d join item_windows i on d.h = i.h and d.w = i.w
), found as materialized (
  select no, item, any_value(item_windows) as item_windows, count(distinct q) as matched from aligned join totals using (item) group by no, item having count(distinct q) >= 0.5 * any_value(item_windows)
), slotted as (select * from sized where len(list_filter(tpl, lambda x: x in (chr(1), chr(2), chr(3)))) > 0
), own as materialized (select a.*, item_windows, (item_windows + 8) // 2 as reach from aligned a join found using (no, item) where item in (select item from slotted)
), counts as (select no, item, shift, any_value(item_windows) as item_windows, any_value(reach) as reach, count(*) as n from own group by 1, 2, 3
), pieces as (
  select * from (select o.no, o.item, c.shift as anchor, o.q, o.shift, o.item_windows, row_number() over (partition by o.no, o.item, c.shift, o.q order by abs(o.shift - c.shift), o.shift) as rn
    from own o join counts c on o.no = c.no and o.item = c.item and abs(o.shift - c.shift) <= o.reach where c.n < 0.5 * c.item_windows) where rn = 1
), laid as (
  select o.no, o.item, 0 as kind, o.shift as anchor, o.q, o.shift from own o join counts c using (no, item, shift) where c.n >= 0.5 * c.item_windows
  union all select no, item, 1, anchor, q, shift from (select *, count(*) over (partition by no, item, anchor) as n from pieces) where n >= 0.5 * item_windows
  union all select no, item, 2, 0, q, shift from (select o.no, o.item, o.q, o.shift, row_number() over (partition by o.no, o.item, o.q order by c.n desc, o.shift) as rn from own o join counts c using (no, item, shift)) where rn = 1
), spots as (
  select item, w, p, raw[p + 1] as b from (select *, unnest(range(0, len(raw))) as p from slotted)
), filled as (
  select no, pos, raw[pos + 1] as d from (select *, unnest(range(0, len(raw))) as pos from templates where kind = 'd' and no in (select no from own))
), pairs as (
  select distinct l.no, l.item, l.kind, l.anchor, s.b, f.d from laid l join spots s on s.item = l.item and s.b[1] in (chr(1), chr(2), chr(3)) and s.p between l.q and l.q + s.w - 1
  join filled f on f.no = l.no and f.pos = s.p + l.shift and f.d[1] in (chr(1), chr(2), chr(3))
), judged as (
  select l.no, l.item, coalesce(n, 0) as n, coalesce(n = n_b and n = n_d, true) as fits from (select distinct no, item, kind, anchor from laid) l
  left join (select no, item, kind, anchor, count(*) as n, count(distinct b) as n_b, count(distinct d) as n_d from pairs group by all) using (no, item, kind, anchor)
), checked as (select no, item, bool_or(fits) as consistent, max(n) filter (fits) as slots from judged group by 1, 2
), plain as (
  select no, array_to_string(list_transform(raw, lambda x: translate(x, chr(1) || chr(2) || chr(3), '')), ' ') as p, kind, id, len(raw) as n from templates
), short as (select no as item, id as item_id, p from plain where kind = 'b' and n between 1 and 3
), whole as (select no, p from plain where kind = 'd'
)
select d.id as doc_id, s.item_id, item_windows, matched, cast(coalesce(slots, 0) as int) as slots from found join sized s using (item) join (select no, id from templates where kind = 'd') d using (no) left join checked using (no, item) where coalesce(consistent, true)
union all select d.id, s.item_id, 1, 1, 0 from short s join whole using (p) join (select no, id from templates where kind = 'd') d using (no)
""".replace("@units@", "|".join(UNITS))
