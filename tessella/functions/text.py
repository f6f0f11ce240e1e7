"""Text functions, Column to Column, from built-in expressions only. Null gives null unless stated."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
#: White space of any kind, which is what (?U)\s matches. In the classes the ranges before && let letters and Han characters go
#: before all the rest is tried.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACES = rf"[\x00-\x20\x7f-\x{{3000}}&&[{_WHITE}]]+"
NORMALIZE = rf"[\x00-/:-@\[-`{{-\x{{303f}}\x{{ff00}}-\x{{ffef}}&&[{_WHITE}，,。；;：:（）()\[\]【】\-—_/]]+"
KEYWORD_SPLIT = r"[,，;；、/]+"
ELEMENT_SPLIT = r"[,，;；、/|]+"
TITLE_SPLIT = r"(?U)[（）()\[\]【】、，,；;：:\s]+"
COMPLIANCE_VERBS = ["完全响应", "实质性响应", "完全满足", "满足", "符合", "响应"]
DOCUMENT_NOUNS = ["竞争性谈判文件", "谈判文件", "招标文件", "采购文件", "询价文件", "招标要求"]
HEADING_PREFIXES = ["工程", "项目", "施工", "本工程", "本项目"]
HEADING_SUFFIXES = ["保障", "措施", "方案", "评价", "管理", "控制", "要求", "体系"]
SUBSTANTIAL_KEYWORDS = ["完全响应", "完全满足", "实质性响应", "无偏离", "满足要求", "符合要求", "不低于"]
HEADING_LINE = r"^(?:第[一二三四五六七八九十百零\d]+[章节篇部]|[（(]?[一二三四五六七八九十百零\d]+[）)、\.．、]|\d+(?:\.\d+){1,3}[\s、.．])"
SENTENCE_ENDS = ["。", "；", ";", "！", "!"]
OPENING = r"^([针对为按照根据结合通过采用将本工程本项目本章本节本文][^，,。；;：:\n]{0,6})[，,：:；;]"
STANDARD_CODE = (
    r"(?i)(?:GB/?T?\s*[\d.]+(?:\s*[-—－]\s*\d{4})?|DL/?T?\s*[\d.]+(?:\s*[-—－]\s*\d{4})?|JGJ/?T?\s*[\d.]+(?:\s*[-—－]\s*\d{4})?"
    r"|NB/?T?\s*[\d.]+(?:\s*[-—－]\s*\d{4})?|Q/?GDW\s*[\d.]+(?:\s*[-—－]\s*\d{4})?|SL/?T?\s*[\d.]+(?:\s*[-—－]\s*\d{4})?"
    r"|CJJ/?T?\s*[\d.]+(?:\s*[-—－]\s*\d{4})?)"
)
FACT_PAIR = r"(?:^|[\n；;。])\s*([\x{4e00}-\x{9fff}A-Za-z0-9（）()]{2,20})\s*[:：为是]\s*([^\n；;。]{1,40})"
PLACE_NAME = r"([\x{4e00}-\x{9fff}]{2,3}(?:省|市|县|区))"
TOKEN = r"[\x{4e00}-\x{9fff}]{2,}|[A-Za-z0-9]{2,}"
MATCH_TOKEN = r"[\x{4e00}-\x{9fff}]{2,8}|[A-Za-z0-9]{2,}"
DAY_UNIT = r"(\d+)\s*(?:个日历日|(?:个)?日历天|日历日|天|日)"
CATALOG_FIRST = [
    r"^[（(]\s*([一二三四五六七八九十百]+)\s*[）)]\s*(.+)$",
    r"^第\s*([一二三四五六七八九十百\d]+)\s*[章节部分篇]\s*(.+)$",
    r"^([一二三四五六七八九十]+)\s*[、．.]\s*(.+)$",
]
CATALOG_NUMBER = r"^(\d{1,2}(?:\.\d+)*)[\s.．、]+(.+)$"
MONEY = r"(\d+(?:\.\d+)?)\s*万元|(\d{4,})\s*元"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends. Only the ends are looked at."""
    return F.btrim(x, F.lit(WHITE))


def rstrip(x: Column) -> Column:
    """Without white space of any kind at the end."""
    return F.rtrim(x, F.lit(WHITE))


def normalize_for_match(x: Column) -> Column:
    """Without white space, punctuation, brackets, dashes; null: empty."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), NORMALIZE, "")


def _parts(x: Column, pattern: str) -> Column:
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), pattern), strip)
    return F.filter(parts, lambda p: p != "")


def split_keywords(x: Column) -> Column:
    """Null: none."""
    return _parts(x, KEYWORD_SPLIT)


def split_mandatory_elements(x: Column) -> Column:
    """Null: none."""
    return _parts(x, ELEMENT_SPLIT)


def distinct_by(xs: Column, key, least: int) -> Column:
    """The first of equal keys, in order; keys of fewer characters than `least` go."""
    pairs = F.filter(F.transform(xs, lambda x: F.struct(key(x).alias("k"), x.alias("x"))), lambda p: F.length(p["k"]) >= least)
    return let(pairs, lambda ps: F.transform(F.filter(ps, lambda p, i: F.array_position(ps["k"], p["k"]) == i + 1), lambda p: p["x"]))


def let(x: Column, body) -> Column:
    """body(x) with x evaluated once, also where body uses it within lambdas."""
    return F.element_at(F.transform(F.array(x), body), 1)


def contains_any(x: Column, words: list[str]) -> Column:
    return x.rlike("|".join(map(re.escape, words)))


def is_compliance_phrase(x: Column) -> Column:
    """(I06)"""
    n = normalize_for_match(x)
    return (F.length(n) >= 6) & contains_any(n, COMPLIANCE_VERBS) & contains_any(n, ["要求", "规定", "文件"])


def phrase_covered(text: Column, phrase: Column) -> Column:
    """Whether a phrase is in the text: as it is, normalised, with another verb of compliance, or by verb and noun. An
    empty phrase is. (I04, I05)"""
    return let(phrase_parts(text, phrase), lambda x: x["plain"] | (x["noun"] & x["verb"]))


def phrase_covered_in(text: Column, normal: Column, phrase: Column) -> Column:
    """phrase_covered() of a text, not null, whose normalised form is a column of its own: made once for all phrases."""
    raw = strip(F.coalesce(phrase, F.lit("")))
    return let(covered_parts(text, raw, normal, normalize_for_match(raw)), lambda x: x["plain"] | (x["noun"] & x["verb"]))


def phrase_parts(text: Column, phrase: Column) -> Column:
    """What makes a phrase covered: (plain, noun, verb). Over several texts, plain in one or noun and verb in any will do."""
    plain = F.struct(F.coalesce(text, F.lit("")).alias("text"), strip(F.coalesce(phrase, F.lit(""))).alias("raw"))
    both = let(plain, lambda x: F.struct(x["text"].alias("text"), x["raw"].alias("raw"), normalize_for_match(x["text"]).alias("t"), normalize_for_match(x["raw"]).alias("p")))
    return let(both, lambda x: covered_parts(x["text"], x["raw"], x["t"], x["p"]))


def covered_parts(text: Column, raw: Column, t: Column, p: Column) -> Column:
    """phrase_parts() of a text and a phrase whose normalised forms, t and p, are known."""
    verbs = F.array(*map(F.lit, COMPLIANCE_VERBS))

    def swapped(v_from: Column) -> Column:
        at = F.instr(p, v_from)
        other = lambda v_to: (v_to != v_from) & F.contains(t, F.concat(F.substr(p, F.lit(1), at - 1), v_to, F.substr(p, at + F.length(v_from))))
        return F.contains(p, v_from) & F.exists(verbs, other)

    nouns = F.filter(F.array(*map(F.lit, sorted(DOCUMENT_NOUNS, key=len, reverse=True))), lambda n: F.contains(p, n))
    core = reduce(lambda c, v: F.replace(c, F.lit(v), F.lit("")), [*sorted(COMPLIANCE_VERBS, key=len, reverse=True), "要求", "规定"], p)
    noun = F.coalesce(F.get(nouns, 0), F.when(F.length(core) >= 4, core), F.lit(""))
    plain = (raw == "") | F.contains(text, raw) | ((p != "") & F.contains(t, p))
    says = is_compliance_phrase(raw)
    return F.struct(
        F.when(plain, True).when(~says, False).otherwise(F.exists(verbs, swapped)).alias("plain"),
        F.when(~says, False).otherwise((noun != "") & F.contains(t, noun)).alias("noun"),
        F.when(~says, False).otherwise(contains_any(t, COMPLIANCE_VERBS) | contains_any(text, SUBSTANTIAL_KEYWORDS)).alias("verb"),
    )


def keyword_core_variants(keyword: Column) -> Column:
    """The keyword without usual beginnings and endings."""
    return distinct_by(_variants(keyword), normalize_for_match, 2)


def _variants(keyword: Column) -> Column:
    """The keyword, stripped, and it without usual beginnings and endings; some may be alike."""

    def of(raw: Column) -> Column:
        cut_start = [F.when(raw.startswith(p) & (F.length(raw) - len(p) >= 2), F.substr(raw, F.lit(len(p) + 1))) for p in HEADING_PREFIXES]
        ends = lambda s: F.array_compact(F.array(*[F.when(s.endswith(x) & (F.length(s) - len(x) >= 2), F.substr(s, F.lit(1), F.length(s) - len(x))) for x in HEADING_SUFFIXES]))
        return let(F.array_compact(F.array(raw, *cut_start)), lambda stems: F.concat(F.array(raw), stems, F.flatten(F.transform(stems, ends))))

    return let(strip(F.coalesce(keyword, F.lit(""))), of)


def keyword_covered_in_headings(headings: Column, keyword: Column) -> Column:
    """(I08)"""
    norms = F.transform(F.filter(headings, lambda h: F.coalesce(h, F.lit("")) != ""), normalize_for_match)
    variants = F.transform(keyword_core_variants(keyword), normalize_for_match)
    hit = lambda hs: F.exists(variants, lambda v: F.exists(hs, lambda h: F.contains(h, v) | ((F.length(h) >= 4) & F.contains(v, h))))
    return let(norms, hit)


def coverage_candidates(title: Column, keyword: Column) -> Column:
    """Title, keywords and the title's words of 2 to 10 characters."""
    item = strip(F.coalesce(title, F.lit("")))
    words = F.filter(F.transform(F.split(item, TITLE_SPLIT), strip), lambda w: F.length(w).between(2, 10))
    return distinct_by(F.concat(F.filter(F.array(item), lambda x: x != ""), split_keywords(keyword), words), normalize_for_match, 2)


def matched_candidates(content: Column, candidates: Column) -> Column:
    """The candidates that occur, themselves or as a core variant, after normalisation."""
    return let(normalize_for_match(content), lambda t: F.filter(candidates, lambda c: F.exists(_forms(c), lambda n: F.contains(t, n))))


def _forms(candidate: Column) -> Column:
    own = F.filter(F.array(normalize_for_match(candidate)), lambda n: n != "")
    return F.concat(own, F.filter(F.transform(_variants(candidate), normalize_for_match), lambda n: F.length(n) >= 2))


def candidate_forms(candidates: Column) -> Column:
    """The normalised forms of all candidates: a text that holds one of them, normalised, matches."""
    return F.array_distinct(F.flatten(F.transform(candidates, _forms)))


def line_as_heading(line: Column) -> Column:
    """The heading's text, or null."""

    def of(s: Column) -> Column:
        ends = reduce(lambda a, b: a | b, [s.endswith(e) for e in SENTENCE_ENDS])
        marked = F.nullif(strip(F.regexp_replace(s, "^#+", "")), F.lit(""))
        return F.when(s.startswith("#"), marked).when((s != "") & (F.length(s) < 60) & ~ends & s.rlike(HEADING_LINE), s)

    return let(strip(line), of)


def split_lines(x: Column) -> Column:
    t = F.coalesce(x, F.lit(""))
    return F.when(F.contains(t, F.lit("\r")), F.split(t, r"\r\n|\r|\n")).otherwise(F.split(t, "\n"))


def headings(text: Column) -> Column:
    """(I12)"""
    return F.array_compact(F.transform(split_lines(text), line_as_heading))


def title_scope_match(heading: Column, title: Column) -> Column:
    """(D12)"""
    h, t = normalize_for_match(heading), normalize_for_match(title)
    return (h != "") & (F.length(t) >= 3) & (F.contains(h, t) | F.contains(t, h))


def body_paragraphs(content: Column) -> Column:
    """Blocks between blank lines, without heading lines."""
    blocks = F.split(F.coalesce(content, F.lit("")), r"\n(?U:\s*)\n")
    lines = F.transform(blocks, lambda b: F.filter(F.transform(split_lines(b), strip), lambda x: x != ""))
    body = F.transform(lines, lambda ls: F.array_join(F.filter(ls, lambda x: ~x.startswith("#")), "\n"))
    return F.filter(body, lambda b: b != "")


def paragraph_opening(text: Column) -> Column:
    """Normalised opening phrase, or the first five characters; empty below three."""
    unlisted = F.regexp_replace(F.regexp_replace(strip(text), r"^[-*+](?U:\s+)", ""), r"^\d+[.、](?U:\s+)", "")
    three = lambda x, other: let(normalize_for_match(x), lambda n: F.when(F.length(n) >= 3, n).otherwise(other))
    return let(unlisted, lambda s: three(F.regexp_extract(s, OPENING, 1), three(F.substring(s, 1, 5), F.lit(""))))


def standard_core(code: Column) -> Column:
    """(I16)"""
    s = F.regexp_replace(F.upper(F.coalesce(code, F.lit(""))), r"(?U)[\s/]", "")
    return F.regexp_replace(F.translate(s, "—－", "--"), r"-\d{4}$", "")


def standard_codes(text: Column) -> Column:
    """Standard codes in order, the first spelling of each."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(STANDARD_CODE), F.lit(0))
    return F.transform(distinct_by(found, standard_core, 5), lambda c: F.regexp_replace(strip(c), r"\s+", " "))


def fact_pairs(text: Column) -> Column:
    """Up to 30 (key, value)."""
    take = lambda g: F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FACT_PAIR), F.lit(g)), strip)
    pairs = F.zip_with(take(1), take(2), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return F.slice(F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != "")), 1, 30)


def location_parts(x: Column) -> Column:
    """(I20)"""
    loc = strip(F.coalesce(x, F.lit("")))
    parts = F.regexp_extract_all(loc, F.lit(PLACE_NAME), F.lit(1))
    return F.when((loc != "") & ~F.array_contains(parts, loc), F.array_append(parts, loc)).otherwise(parts)


def normalize_ai_spacing(x: Column) -> Column:
    """(I21)"""
    s = F.regexp_replace(F.replace(x, F.lit("\u3000"), F.lit(" ")), " {2,}", " ")
    s = F.regexp_replace(s, r"([\x{4e00}-\x{9fff}]) (?=[A-Za-z0-9])", "$1")
    return F.regexp_replace(s, r"([A-Za-z0-9]) (?=[\x{4e00}-\x{9fff}])", "$1")


def solid_length(x: Column) -> Column:
    """Characters that are no white space."""
    return F.length(F.regexp_replace(F.coalesce(x, F.lit("")), SPACES, ""))


def tokens(x: Column) -> Column:
    """Han runs and alphanumeric runs of two and more."""
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(TOKEN), F.lit(0))


def match_tokens(x: Column) -> Column:
    """Distinct Han runs of 2 to 8 and alphanumeric runs."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(MATCH_TOKEN), F.lit(0)))


def topic_snippet(body: Column, most: int = 36) -> Column:
    """First sentence if it ends after the ninth character, else the beginning; an ellipsis where a sentence is cut."""
    text = F.regexp_replace(strip(F.coalesce(body, F.lit(""))), r"(?U)\s+", " ")
    head = F.regexp_extract(text, r"^([^。；;！!？?\n]*)[。；;！!？?\n]", 1)
    s = F.when(F.length(head) > 8, F.substr(text, F.lit(1), F.length(head) + 1)).otherwise(F.substring(text, 1, most))
    return F.when(F.length(s) > most, F.concat(F.regexp_replace(F.substring(s, 1, most - 1), r"(?U)\s+$", ""), F.lit("…"))).otherwise(s)


def labeled_chunk(text: Column, source: Column, folder: Column) -> Column:
    """The text under a label of its source."""
    src, top = strip(F.coalesce(source, F.lit(""))), F.coalesce(folder, F.lit(""))
    joined = F.regexp_replace(F.concat(top, F.lit("/"), src), "^/+|/+$", "")
    label = F.when((top != "") & (src != "") & ~F.startswith(src, top), joined).when(src != "", src).when(top != "", top).otherwise("知识库")
    return F.concat(F.lit("[来源："), label, F.lit("]\n"), strip(F.coalesce(text, F.lit(""))))


def evidence_snippet(text: Column, candidates: Column, window: int = 60) -> Column:
    """The surroundings of the first candidate that occurs; empty if none does."""
    t = F.coalesce(text, F.lit(""))
    first = F.get(F.filter(candidates, lambda c: (c != "") & F.contains(t, c)), 0)
    at = F.instr(t, first)
    begin = F.greatest(at - window, F.lit(1))
    return F.coalesce(strip(F.substr(t, begin, at + F.length(first) + window - begin)), F.lit(""))


def table_cells(row: Column) -> Column:
    """Cells of a table row, split at bars that are not escaped."""
    inner = F.regexp_replace(F.regexp_replace(strip(row), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda c: F.replace(strip(c), F.lit("\\|"), F.lit("|")))


def money_yuan(text: Column) -> Column:
    """Amounts in yuan, in order."""
    t = F.coalesce(text, F.lit(""))
    part = lambda g: F.regexp_extract_all(t, F.lit(MONEY), F.lit(g))
    return F.zip_with(part(1), part(2), lambda wan, yuan: F.coalesce(wan.try_cast("double") * 10000, yuan.try_cast("double")))


def duration_days(text: Column) -> Column:
    """First whole number before a unit of days, else null."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), DAY_UNIT, 1).try_cast("int")


DIGITS = "〇一二三四五六七八九"


def chinese_number(n: Column) -> Column:
    """1 to 99 in Chinese; others as digits."""
    digit = lambda d: F.substr(F.lit(DIGITS), d.cast("int") + 1, F.lit(1))
    tens, ones = F.floor(n / 10), n % 10
    tail = F.when(ones > 0, digit(ones)).otherwise("")
    return F.when(n.between(1, 9), digit(n)).when(n.between(10, 19), F.concat(F.lit("十"), tail)).when(n.between(20, 99), F.concat(digit(tens), F.lit("十"), tail)).otherwise(n.cast("string"))


def catalog_level(line: Column) -> Column:
    """(level, title) of a catalogue line, null if it is none."""
    s, indent = strip(line), F.length(F.regexp_extract(line, r"^((?U)\s*)", 1))
    title = lambda x: F.regexp_replace(strip(x), "[。.．;；]+$", "")
    item = lambda level, x: F.struct(level.cast("int").alias("level"), title(x).alias("title"))
    out = F.when(indent >= 2, item(F.lit(2), s))
    number = F.regexp_extract(s, CATALOG_NUMBER, 1)
    depth = F.size(F.split(number, r"\."))
    out = F.when(number != "", item(F.when(depth <= 1, 2).otherwise(F.least(depth, F.lit(4))), F.regexp_extract(s, CATALOG_NUMBER, 2))).otherwise(out)
    for pattern in reversed(CATALOG_FIRST):
        out = F.when(s.rlike(pattern), item(F.lit(1), F.regexp_extract(s, pattern, 2))).otherwise(out)
    return F.when(s != "", out)


def text_tokens(x: Column, per_token: float = 0.6) -> Column:
    """Estimated tokens; 0 for an empty text."""
    n = F.length(F.coalesce(x, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / per_token).cast("int")))


def chapter_max_tokens(words: Column) -> Column:
    """(I57)"""
    n = F.coalesce(words, F.lit(0))
    return F.when(n == 0, 4096).otherwise(F.least(F.lit(8000), F.greatest(F.lit(4096), F.floor(n / 0.6).cast("int") + 500)))


def word_count_display(n: Column) -> Column:
    """From 10,000 on in units of that, to two places of the binary value: a tie in decimals is none there."""
    shown = F.call_function("format_number", n / F.lit(10000.0), F.lit("0.00"))
    return F.when(n >= 10000, F.concat(shown, F.lit("万字"))).otherwise(F.concat(n.cast("string"), F.lit("字")))


def capped(x: Column, limit: int, suffix: str) -> Column:
    """At most `limit` characters, the suffix included where text is cut off."""
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit - len(suffix)), F.lit(suffix))).otherwise(x)


def mask_key(x: Column) -> Column:
    """(I61)"""
    return F.when(F.coalesce(x, F.lit("")) == "", "").when(F.length(x) <= 8, "****").otherwise(F.concat(F.left(x, F.lit(4)), F.lit("****"), F.right(x, F.lit(4))))


def safe_filename(title: Column, key: Column) -> Column:
    """(I62)"""
    safe = F.coalesce(F.nullif(strip(F.regexp_replace(F.coalesce(title, F.lit("")), r'[\\/:*?"<>|]', "_")), F.lit("")), key)
    return F.concat(key, F.lit("_"), F.substring(safe, 1, 40), F.lit(".md"))


def meta_line(line: Column) -> Column:
    """(key, value) of `# key: value`, else null."""
    body = F.substr(strip(line), F.lit(3))
    at = F.instr(body, ":")
    pair = F.struct(F.lower(strip(F.substr(body, F.lit(1), at - 1))).alias("key"), strip(F.substr(body, at + 1)).alias("value"))
    return F.when(strip(line).startswith("# ") & (at > 0), pair)


def bounded_int(x: Column, low: int, high: int) -> Column:
    """A whole number moved into the range; null if it is none."""
    n = x.cast("string").try_cast("int")
    return F.when(n.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), n)))


def scaled_words(base: Column, compact: Column) -> Column:
    """(J07)"""
    return F.when(compact, F.greatest(F.lit(200), F.bround(base * 0.6).cast("int"))).otherwise(base)


def parsed_date(x: Column) -> Column:
    """The first ten characters as a date in one of three forms, else null."""
    s = F.substring(strip(x), 1, 10)
    return F.coalesce(*(F.try_to_date(s, f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd")))


def day_label(x: Column) -> Column:
    """(J02)"""
    return F.regexp_extract(F.coalesce(x, F.lit("")), r"第\s*(\d+)\s*天", 1).try_cast("int")


def string_array(raw: Column) -> Column:
    """A JSON array of strings; anything else: none."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))


def error_array(raw: Column) -> Column:
    """A JSON array; any other text: that text alone; blank: none."""
    s = strip(F.coalesce(raw, F.lit("")))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.coalesce(F.when(s.startswith("["), F.from_json(s, "array<string>")), F.array(s)))


def character_grams(x: Column, n: int = 8, keep: str = r"[^\x{4e00}-\x{9fff}]") -> Column:
    """Distinct runs of n of the kept characters."""
    return F.array_distinct(windows(F.regexp_replace(F.coalesce(x, F.lit("")), keep, ""), n))


def windows(x: Column, n: int, stride: int = 1) -> Column:
    """All runs of n characters of a text, one from every stride-th place, in time in proportion to it. A match takes whole
    characters, so none begins within one."""
    return F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{n}}})).{{1,{stride}}}"), F.lit(1))
