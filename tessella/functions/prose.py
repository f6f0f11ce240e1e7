"""Functions that rewrite or pick from running text, Column to Column, from built-in expressions only. Null counts as
empty unless stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, let, normalize_ai_spacing, strip

# Phrases and patterns that results depend on.
COMPANY_MARKERS = ["本公司", "我公司", "我方公司", "投标人名称", "投标单位"]
IDENTITY_PATTERNS = [
    r"[\x{4e00}-\x{9fff}]{2,20}(?:有限公司|股份有限公司|集团)",
    r"(?:统一社会信用代码|组织机构代码)\s*[:：]?\s*[A-Z0-9]{10,}",
    r"(?:联系人|项目经理)\s*[:：]\s*[\x{4e00}-\x{9fff}]{2,4}(?![员工])",
]
CONTRACT_NUMBER = r"(?:合同编号|合同号)\s*[:：]?\s*[A-Za-z0-9\-_/]{4,}"
CLICHES = [
    "综上所述", "总体而言", "总的来说", "总而言之", "值得注意的是", "需要指出的是", "不难发现", "众所周知", "显而易见", "毋庸置疑", "在当今社会",
    "随着时代的发展", "随着社会经济的发展", "具有重要意义", "发挥重要作用", "全方位", "多层次", "深度融合", "赋能", "助力", "底层逻辑", "顶层设计",
    "闭环管理", "闭环", "颗粒度", "不仅如此", "更重要的是",
]
#: Of these only occurrences before a comma count.
FILLERS = ["值得注意的是", "需要指出的是", "不难发现", "众所周知", "显而易见", "毋庸置疑", "不仅如此", "更重要的是"]
#: Dropped where a paragraph or sentence begins with them.
OPENERS = ["综上所述", "总体而言", "总的来说", "总而言之", "在当今社会", "随着时代的发展", "随着社会经济的发展"]
REPLACED = {"赋能": "支持", "助力": "帮助", "底层逻辑": "基本原理", "顶层设计": "整体规划", "闭环": "全流程", "颗粒度": "细致程度"}
VARIED = {"采用": ("使用", "选用"), "实现": ("完成", "达到"), "确保": ("保证", "保障")}


def _literal(word: str | Column) -> str | Column:
    return F.concat(F.lit(r"\Q"), word, F.lit(r"\E")) if isinstance(word, Column) else rf"\Q{word}\E"


def occurrences(x: Column, word: str | Column) -> Column:
    """Where the word begins, from 0, without overlaps."""
    n = F.length(word) if isinstance(word, Column) else F.lit(len(word))
    pieces = F.split(x, _literal(word), -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, p: F.struct((acc["at"] + F.length(p) + n).alias("at"), F.array_append(acc["out"], acc["at"] + F.length(p)).alias("out"))
    found = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step, lambda acc: acc["out"])
    return F.when(F.contains(x, word if isinstance(word, Column) else F.lit(word)), found).otherwise(F.array().cast("array<int>"))


def cliches(x: Column) -> Column:
    """(start, end, phrase) of all occurrences of the phrases, fillers with their comma, by start; of overlapping phrases
    all are told. (I52)"""
    x = F.coalesce(x, F.lit(""))

    def each(i: int, w: str) -> Column:
        search = f"{w}，" if w in FILLERS else w
        return F.transform(occurrences(x, search), lambda at: F.struct(at.alias("start"), F.lit(i).alias("i"), (at + len(search)).alias("end"), F.lit(w).alias("phrase")))

    hits = F.array_sort(F.concat(*(each(i, w) for i, w in enumerate(CLICHES))))
    return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["phrase"].alias("phrase")))


def split_long_sentences(x: Column) -> Column:
    """Sentences of more than 120 characters and two commas are cut at the comma in their middle."""

    def cut(s: Column) -> Column:
        parts = F.split(s, "，", -1)
        half = F.floor(F.size(parts) / 2).cast("int")
        halves = F.concat(F.array_join(F.slice(parts, F.lit(1), half), "，"), F.lit("。\n"), F.array_join(F.slice(parts, half + 1, F.size(parts)), "，"))
        return F.when((F.length(s) > 120) & (F.size(parts) > 2), halves).otherwise(s)

    sentences = lambda b: F.filter(F.transform(F.split(b, "(?<=[。；])", -1), strip), lambda s: s != "")
    return F.array_join(F.transform(F.split(F.coalesce(x, F.lit("")), "\n\n", -1), lambda b: F.array_join(F.transform(sentences(b), cut), "")), "\n\n")


def humanize(x: Column) -> Column:
    """Texts of 80 characters and more: set phrases replaced or dropped, frequent verbs varied from their fourth
    occurrence on, long sentences split, spacing set right. Others stay, null too. (I53)"""
    out = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), REPLACED.items(), x)
    for w in OPENERS:
        for mark in "，。":
            out = F.replace(out, F.lit(f"\n{w}{mark}"), F.lit("\n"))
            out = F.regexp_replace(out, f"^{w}{mark}", "")
            for said in dict.fromkeys((f"。{w}{mark}", f"。{w}，", f"。{w}。")):
                out = F.replace(out, F.lit(said), F.lit("。"))
    for w in FILLERS:
        out = F.regexp_replace(F.replace(out, F.lit(f"\n{w}，"), F.lit("\n")), f"^{w}，", "")
    for word, others in VARIED.items():
        out = _varied(out, word, others)
    return F.when(F.length(x) < 80, x).otherwise(normalize_ai_spacing(split_long_sentences(out)))


def _varied(text: Column, word: str, others: tuple[str, str]) -> Column:
    lead = lambda i: F.when(i == 0, "").when(i <= 3, word).when(i % 2 == 0, others[0]).otherwise(others[1])
    joined = lambda ps: F.array_join(F.when(F.size(ps) > 5, F.transform(ps, lambda p, i: F.concat(lead(i), p))).otherwise(F.transform(ps, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(word), p)))), "")
    return let(F.split(text, _literal(word), -1), joined)


def scrub_identity(x: Column) -> Column:
    """Names of companies, credit codes, contacts and contract numbers made general."""
    out = reduce(lambda t, p: F.regexp_replace(t, p, "投标人"), IDENTITY_PATTERNS, F.coalesce(x, F.lit("")))
    out = reduce(lambda t, w: F.replace(t, F.lit(w), F.lit("投标人")), COMPANY_MARKERS, out)
    return F.regexp_replace(out, CONTRACT_NUMBER, "合同编号：类似工程")


def passages(x: Column) -> Column:
    """Paragraphs of 40 characters and more; those above 800 packed anew from their sentences, to about 500."""
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), r"\n(?U:\s*)\n+", -1), lambda p: strip(F.regexp_replace(p, "[ \t]+", " ")))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("buf"), none.alias("out"))
    put = lambda out, buf: F.when(strip(buf) != "", F.array_append(out, strip(buf))).otherwise(out)

    def step(acc: Column, s: Column) -> Column:
        full = (F.length(acc["buf"]) + F.length(s) > 500) & (acc["buf"] != "")
        packed = F.struct(F.when(full, s).otherwise(F.concat(acc["buf"], s)).alias("buf"), F.when(full, put(acc["out"], acc["buf"])).otherwise(acc["out"]).alias("out"))
        return F.when(strip(s) == "", acc).otherwise(packed)

    packed = lambda p: F.aggregate(F.split(p, "(?<=[。！？；])", -1), start, step, lambda acc: put(acc["out"], acc["buf"]))
    return F.flatten(F.transform(F.filter(parts, lambda p: F.length(p) >= 40), lambda p: F.when(F.length(p) > 800, packed(p)).otherwise(F.array(p))))


def passage_score(passage: Column, terms: Column) -> Column:
    """Terms that occur over a penalty for length."""
    return F.size(F.filter(terms, lambda t: (t != "") & F.contains(passage, t))) / F.greatest(F.least(F.length(passage) / F.lit(600.0), F.lit(1.5)), F.lit(0.5))


def reference_query(title: Column, brief: Column, boundary: Column, titles: Column) -> Column:
    """What is asked of a reference: title, beginnings of brief and boundary, five titles of requirements."""
    some = lambda x, n: F.substring(strip(F.coalesce(x, F.lit(""))), 1, n)
    parts = F.concat(F.array(F.coalesce(title, F.lit("")), some(brief, 120), some(boundary, 160)), F.slice(F.coalesce(titles, F.array().cast("array<string>")), 1, 5))
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def reference_snippets(text: Column, terms: Column, top_k: int = 4, most: int = 1800, head: bool = False) -> Column:
    """The passages that hold most terms, up to `most` characters together (the first always), made anonymous. A text
    within `most` comes whole; without a hit nothing comes, or with `head` the text's beginning. (G04)"""
    whole = strip(F.coalesce(text, F.lit("")))
    begin = F.substring(whole, 1, most) if head else F.lit("")
    terms = F.slice(F.filter(terms, lambda t: F.length(t) >= 2), 1, 40)
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        n = acc["n"] + F.length(p)
        stop = acc["full"] | ((n > most) & (F.size(acc["out"]) > 0))
        return F.when(stop, F.struct(acc["n"].alias("n"), F.lit(True).alias("full"), acc["out"].alias("out"))).otherwise(F.struct(n.alias("n"), (n >= most).alias("full"), F.array_append(acc["out"], p).alias("out")))

    def chosen(ps: Column) -> Column:
        ranked = F.array_sort(F.filter(F.transform(ps, lambda p, i: F.struct((-passage_score(p, terms)).alias("s"), i.alias("i"), p.alias("p"))), lambda r: r["s"] < 0))
        return F.aggregate(F.slice(ranked["p"], 1, top_k), start, step, lambda acc: acc["out"])

    joined = lambda ps: F.array_join(ps, "\n\n---\n\n")
    cut = lambda b: F.when(F.length(b) > most, F.concat(F.regexp_replace(F.substring(b, 1, most), r"(?U)\s+$", ""), F.lit("…"))).otherwise(b)
    picked = let(let(passages(whole), chosen), lambda ps: F.when(F.size(ps) == 0, begin).otherwise(cut(joined(ps))))
    return scrub_identity(F.when(F.length(whole) <= most, whole).otherwise(picked))


def negated(text: Column, word: Column, markers: tuple[str, ...] = ("不写", "不得", "不含", "不涉及", "禁止", "勿", "不展开", "不做", "不出现")) -> Column:
    """Whether some mention of the word has a negation among the six characters before it."""
    before = lambda at: F.substr(text, F.greatest(at - 5, F.lit(1)), F.least(at, F.lit(6)))
    return F.exists(occurrences(text, word), lambda at: contains_any(before(at), list(markers)))
