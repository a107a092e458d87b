"""Text functions as column expressions: cleaning, chunking, tokens, and tests of shape."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of chunking and evaluation.
CHUNK_SIZE, OVERLAP, LEAST_CHUNK = 400, 50, 120
CJK = "㐀-䶿一-鿿豈-﫿"
RUNS = f"[{CJK}]+|[A-Za-z0-9]+"
BOUNDARY = r'^[A-Za-z一-鿿0-9（(“"]'
SENTENCE_END = "[。！？]"
META_WORDS = "这段|该片段|上述|上文|文中|书中|书里|文档中|本段|该文档"
SLUGS = {"dietary_guide": "diet", "力量训练基础": "strength"}

NO_CONTEXT = "（未检索到相关文档片段）"
ANSWER_PROMPT = """你是健身营养助手。请只根据下面提供的文档片段回答用户问题，不要编造文档外的内容；若片段不足以回答，请如实说明。

文档片段：
%s"""
RECIPE_PROMPT = "你是注册营养师，根据用户的热量与宏量目标推荐中式家常菜谱，热量和宏量尽量贴近目标。"
PLAN_PROMPT = "你是健身教练，根据部位、水平、器械生成训练计划。"
JUDGE_USER = "【文档片段】\n%s\n\n【用户问题】\n%s\n\n【系统回答】\n%s"
PROMPT_VERSIONS = {"recipe": "v1", "plan": "v1", "answer": "v1", "judge": "v2"}

#: What a judge is told, in our own words; scores are those of evaluation.AXES.
JUDGE_PROMPT = """你要评审一个问答系统的回答，只看给出的文档片段、用户问题和系统回答，不用自己的知识判断对错。
三项各自打 1 到 5 分，互不影响，并用一两句话写出理由（reasoning）：
faithfulness：回答里的陈述有多少能在片段里找到依据；片段不足而如实说明的，给 5 分。
relevance：回答是否一直在谈所问的事；如实说明无法回答的，给 5 分。
sufficiency：用户是否从回答里得到了想知道的；没有回答的，给 1 分。"""

_STRIP = r"(?U)^\s+|\s+$"


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, _STRIP, "")


def norm_ws(x: Column) -> Column:
    """Without any Unicode white space."""
    return F.regexp_replace(x, r"(?U)\s+", "")


def tokenize(x: Column) -> Column:
    """Runs of CJK characters as bigrams (a single one whole), runs of ASCII letters and digits in lower case."""
    runs = F.regexp_extract_all(x, F.lit(RUNS), F.lit(0))
    n = F.length
    bigrams = lambda run: F.transform(F.sequence(F.lit(1), F.greatest(n(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda run: F.when(run.rlike("^[A-Za-z0-9]"), F.array(F.lower(run))).otherwise(bigrams(run))))


_RUNS, _CJK_RUN = re.compile(RUNS), re.compile(f"[{CJK}]")


def tokens_of(x: str) -> list[str]:
    """What tokenize gives, for one text in a task."""
    if x.isascii():
        return _RUNS.findall(x.lower())
    x = x.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes have ASCII letters only to lower
    runs = _RUNS.findall(x)
    if not _CJK_RUN.search(x):
        return runs
    out: list[str] = []
    for run in runs:
        if run.isascii() or len(run) == 1:
            out.append(run)
        else:
            out.extend(map(add, run, run[1:]))
    return out


def clean(x: Column) -> Column:
    """Single spaces, stripped lines without empty ones, paragraphs apart by one blank line."""
    text = F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"[ \t]+", " ")
    lines = lambda p: F.filter(F.transform(F.split(p, "\n"), strip), lambda line: line != "")
    paragraphs = F.transform(F.split(text, "\n\n"), lambda p: F.array_join(lines(p), "\n"))
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n")


def merged(paragraphs: Iterable[str], least: int = LEAST_CHUNK) -> list[str]:
    """Joins short paragraphs to the following ones until each has `least` characters.

    What is left over goes to the last one; alone it stays if it has a fifth of `least`, else it goes."""
    done: list[str] = []
    held: list[str] = []
    size = 0
    for p in paragraphs:
        if not p and not held:
            continue
        size += len(p) + bool(held)
        held.append(p)
        if size >= least:
            done.append("\n".join(held))
            held, size = [], 0
    if held and done:
        done[-1] = "\n".join([done[-1], *held])
    elif held and size >= least // 5:
        done.append("\n".join(held))
    return done


def merge_short(paragraphs: Column, least: int = LEAST_CHUNK) -> Column:
    """An array's paragraphs as `merged` joins them, in one pass over each array; null stays null."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda x: None if x is None else merged(x, least))

    return run(paragraphs)


def windows(p: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """A paragraph whole if it has `size` characters at most, else windows that overlap; a last
    remainder under 100 characters joins the window before it."""
    step = size - overlap
    tail = size + 100
    last = F.when(F.length(p) < tail, F.lit(0)).otherwise(F.floor((F.length(p) - tail) / step) + 1).cast("int")
    piece = lambda k: F.substring(p, k * step + 1, F.when(k == last, F.length(p)).otherwise(F.lit(size)))
    return F.when(F.length(p) <= size, F.array(p)).otherwise(F.transform(F.sequence(F.lit(0), last), piece))


def chunks(cleaned: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP, least: int = LEAST_CHUNK) -> Column:
    """Chunks of a cleaned text: short paragraphs merged, long ones in windows; a text of one paragraph needs no merging."""
    paragraphs = F.filter(F.split(cleaned, "\n\n"), lambda p: p != "")
    return F.flatten(F.transform(merge_short(paragraphs, least), lambda p: windows(p, size, overlap)))


def slug(source: Column) -> Column:
    """A registered slug, else the ASCII letters and digits of the lower-cased source, else src."""
    known = F.coalesce(*(F.when(source == k, F.lit(v)) for k, v in SLUGS.items()))
    return F.coalesce(known, F.nullif(F.regexp_replace(F.lower(source), "[^a-z0-9]+", ""), F.lit("")), F.lit("src"))


def excerpt(x: Column, n: int) -> Column:
    """The first n characters, line ends shown as ' / '."""
    return F.replace(F.left(x, F.lit(n)), F.lit("\n"), F.lit(" / "))


def starts_mid_sentence(x: Column) -> Column:
    return ~x.rlike(BOUNDARY)


def looks_like_table(x: Column) -> Column:
    """At least six non-empty lines of median length 18 at most, and two sentence ends at most."""
    lengths = F.array_sort(F.transform(F.filter(F.transform(F.split(x, "\n"), strip), lambda v: v != ""), F.length))
    n = F.size(lengths)
    at = lambda i: F.try_element_at(lengths, i.cast("int"))
    median = (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2
    return (n >= 6) & (F.regexp_count(x, F.lit(SENTENCE_END)) <= 2) & (median <= 18)


def eligible_for_questions(x: Column, least: int = 150) -> Column:
    """Long enough, from a boundary, and with enough CJK characters."""
    text = strip(F.coalesce(x, F.lit("")))
    return (F.length(text) >= least) & text.rlike(BOUNDARY) & (F.regexp_count(text, F.lit("[一-鿿]")) >= least // 4)


def common_length(a: str, b: str) -> int:
    """Length of the longest common substring of two texts.

    Every place of both texts gets the class of the substring that begins there, for lengths 1, 2, 4 and on, as long as a
    class is met in both; a class of double length is a pair of classes. The powers below are then added from the greatest
    down. Classes are exact, so nothing needs confirming; a step sorts one array as long as both texts."""
    both = np.concatenate([np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b)]).astype(np.int64)
    n, least = len(a), min(len(a), len(b))

    def classes(left: np.ndarray, right: np.ndarray, gap: int, length: int) -> np.ndarray | None:
        """Classes of places from those of the substring there and of that `gap` on; None if none of `length` is in both texts."""
        pairs = np.full(len(both), -1, np.int64)
        for begin, end in ((0, n), (n, len(both))):
            last = end - length + 1
            if last <= begin:
                return None
            pairs[begin:last] = (left[begin:last] << 32) | right[begin + gap : last + gap]
        out = np.unique(pairs, return_inverse=True)[1]
        seen = np.zeros(int(out.max()) + 1, np.uint8)
        seen[out[: n - length + 1]] = 1
        return out if seen[out[n : len(both) - length + 1]].any() else None

    if not least or not np.isin(both[:n], both[n:]).any():
        return 0
    powers, length = [both], 1
    while 2 * length <= least and (doubled := classes(powers[-1], powers[-1], length, 2 * length)) is not None:
        powers.append(doubled)
        length *= 2
    now = powers.pop()
    for power in reversed(range(len(powers))):
        more = 1 << power
        if length + more <= least and (longer := classes(now, powers[power], length, length + more)) is not None:
            now, length = longer, length + more
    return length


@F.pandas_udf(T.IntegerType())
def overlap_length(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Length of the longest common substring of two texts without white space; nulls count as empty."""
    bare = lambda x: "".join((x or "").split())
    for a, b in parts:
        yield pd.Series([common_length(bare(x), bare(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def format_chunks(items: Column) -> Column:
    """An array of (source, text) as one prompt block; a fixed note where it is empty."""
    shown = F.array_join(F.transform(items, lambda x: F.concat(F.lit("【"), x["source"], F.lit("】"), x["text"])), "\n\n")
    return F.when(F.size(items) > 0, shown).otherwise(F.lit(NO_CONTEXT))


def request_prompt(kind: str, request: Column) -> Column:
    """version, system, user of a provider request; kind: recipe or plan. The user message is the request as JSON."""
    system = {"recipe": RECIPE_PROMPT, "plan": PLAN_PROMPT}[kind]
    return F.struct(F.lit(PROMPT_VERSIONS[kind]).alias("version"), F.lit(system).alias("system"), F.to_json(request).alias("user"))


def judge_prompt(question: Column, answer: Column, context: Column) -> Column:
    """The judge's user message; the context is what the answer was made from, letter for letter."""
    return F.format_string(JUDGE_USER, context, question, answer)
