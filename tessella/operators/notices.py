"""A project and the notice of its tender: what the notice says goes to the project, what the project has goes to the notice, and
the grounds for exclusion in one form. Notices are maps of text, so a key that is absent and one that is null are the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import rules

# The keys of a notice, and the fields of a project behind them.
KEYS = ["project_name", "project_code", "package_name", "package_no", "budget_wan", "budget_yuan", "tenderer", "agency", "bid_domain", "overview", "sme_targeted", "blind_bid", "duration_text", "location", "project_type", "contract_mode", "voltage_level", "capacity", "target_pages"]
TEXTS = {"name": "project_name", "voltage_level": "voltage_level", "capacity": "capacity", "location": "location", "project_type": "project_type", "contract_mode": "contract_mode", "engineering_domain": "bid_domain"}
GROUND, DOMAIN, PAGES = "废标项", "电力工程", (10, 1200)


def notice(raw: Column) -> Column:
    """A map of all keys of a notice from a map of some, other keys left out."""
    return F.create_map(*(x for k in KEYS for x in (F.lit(k), F.try_element_at(raw, F.lit(k)))))


def applied(projects: DataFrame, force: bool = False, pages: tuple[int, int] = PAGES) -> DataFrame:
    """projects (notice: a map of text, confirmed: array of fields, and the fields name, voltage_level, capacity, location, project_type,
    contract_mode, engineering_domain, duration_days, budget_yuan, target_pages) with what the notice says in the fields that
    nobody has confirmed by hand, or in all by force. Blank values, durations without a number of days and sums that are no
    numbers leave a field as it is. (M09)"""
    said = lambda key: F.try_element_at("notice", F.lit(key))
    free = lambda field: F.lit(force) | ~F.coalesce(F.array_contains("confirmed", F.lit(field)), F.lit(False))
    put = lambda field, value: F.when(free(field) & value.isNotNull(), value).otherwise(F.col(field)).alias(field)
    new = {field: put(field, F.nullif(said(key), F.lit(""))) for field, key in TEXTS.items()}
    new["duration_days"] = put("duration_days", tx.duration_days(said("duration_text")))
    new["budget_yuan"] = put("budget_yuan", tx.strip(said("budget_yuan")).try_cast("double"))
    new["target_pages"] = put("target_pages", tx.bounded_int(said("target_pages"), *pages))
    return projects.select(*(new.get(c, F.col(c)) for c in projects.columns))


def synced(projects: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """projects (as of applied(), and extra_notes) with a notice that says what the project has: its texts as they are, even null,
    a domain in any case; duration, pages, notes and budget, this also in units of ten thousand, only where it has them. (M10)"""
    plain = lambda x: F.when(x.isNotNull(), F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x), "0+$", ""), r"\.$", ""))
    known = {key: F.col(field) for field, key in TEXTS.items()}
    known["bid_domain"] = F.coalesce(F.nullif("engineering_domain", F.lit("")), F.lit(domain))
    some = {
        "duration_text": F.concat(F.col("duration_days").cast("string"), F.lit("个日历天")), "target_pages": F.col("target_pages").cast("string"), "overview": F.col("extra_notes"),
        "budget_yuan": plain(F.col("budget_yuan")), "budget_wan": plain(F.col("budget_yuan") / 10000),
    }
    value = lambda key: known[key] if key in known else F.coalesce(some[key], F.try_element_at("notice", F.lit(key))) if key in some else F.try_element_at("notice", F.lit(key))
    made = F.create_map(*(x for k in KEYS for x in (F.lit(k), value(k))))
    return projects.select(*(made.alias("notice") if c == "notice" else F.col(c) for c in projects.columns))


def grounds(raw: Column) -> Column:
    """Grounds for exclusion (seq, item_label, description, source_text, source_page) in order of seq from a JSON array of objects;
    anything else: none. Either of description and source text stands for the other; a ground without both goes. A seq that
    is no whole number is the place in the array. (K11)"""
    kind = "array<struct<seq:string,item_label:string,category:string,description:string,source_text:string,source_page:string>>"
    given = F.filter(F.transform(F.from_json(raw, kind), lambda x, k: F.struct(x.alias("x"), (k + 1).alias("k"))), lambda y: y["x"].isNotNull())
    clean = lambda c: F.nullif(tx.strip(F.coalesce(c, F.lit(""))), F.lit(""))

    def one(y: Column) -> Column:
        x = y["x"]
        source, said = clean(x["source_text"]), clean(x["description"])
        label = tx.strip(F.coalesce(F.nullif(x["item_label"], F.lit("")), F.nullif(x["category"], F.lit("")), F.lit(GROUND)))
        return F.struct(F.coalesce(x["seq"].try_cast("int"), y["k"]).alias("seq"), y["k"].alias("k"), label.alias("item_label"), F.coalesce(said, source).alias("description"), F.coalesce(source, said).alias("source_text"), x["source_page"].try_cast("int").alias("source_page"))

    kept = F.array_sort(F.filter(F.transform(given, one), lambda g: g["description"].isNotNull()))
    fields = ("seq", "item_label", "description", "source_text", "source_page")
    none = F.filter(F.array(F.struct(F.lit(0).alias("seq"), *(F.lit("").alias(f) for f in fields[1:4]), F.lit(0).alias("source_page"))), lambda x: F.lit(False))
    return F.coalesce(F.transform(kept, lambda g: F.struct(*(g[f].alias(f) for f in fields))), none)


def hard_checks(chapters: DataFrame, scope: str = "chapter", only: tuple[str, ...] | None = None) -> DataFrame:
    """(id, errors, notes) of chapters (as of rules.findings()): the messages of findings that block, for which a chapter is written
    again, and of the others, by rule and message (of all rules, or of `only` some); of a segment the others only where none blocks. Chapters without findings
    have no row. (Y30, Y31)"""
    found = rules.findings(chapters, scope, only)
    blocks = F.col("severity") == "block"
    said = lambda which: F.sort_array(F.collect_list(F.when(which, F.struct("check_id", "message"))))
    by = found.groupBy("id").agg(said(blocks).alias("e"), said(~blocks).alias("n"))
    notes = F.col("n")["message"]
    if scope == "segment":
        notes = F.when(F.size("e") > 0, F.array().cast("array<string>")).otherwise(notes)
    return by.select("id", F.col("e")["message"].alias("errors"), notes.alias("notes"))
