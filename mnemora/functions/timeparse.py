"""Chinese time expressions: a table of patterns, each with the period it denotes, and a confidence.

Pure functions of (text, now); ``parse_column`` applies them to a column in Arrow batches.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F

from mnemora.functions.lexer import learnable
from mnemora.functions.stopwords import STOPWORDS

_DIGIT = dict(zip("零一二三四五六七八九", range(10))) | dict(zip("〇壹贰叁肆伍陆柒捌玖", range(10))) | {"两": 2}
_TEN = "十拾"
_YEARS_BACK = {"今": 0, "去": 1, "前": 2, "大前": 3}


def number(s: str | None) -> int | None:
    """An Arabic number, or a Chinese one up to 99."""
    if not s:
        return None
    if s.isdigit():
        return int(s)
    m = re.fullmatch(f"(.)?[{_TEN}](.)?", s)
    if m:
        tens = 1 if m[1] is None else _DIGIT.get(m[1])
        ones = 0 if m[2] is None else _DIGIT.get(m[2])
        return None if tens is None or ones is None else 10 * tens + ones
    return _DIGIT.get(s) if len(s) == 1 else None


def _year(prefix: str, today: date) -> int:
    return int(prefix) if prefix.isdigit() else today.year - _YEARS_BACK[prefix]


def _days(first: date, last: date) -> tuple[date, date] | bool:
    """The period; False for an inverted one, which ends the search without a match."""
    return (first, last) if first <= last else False


def _month(year: int, month: int) -> tuple[date, date]:
    return date(year, month, 1), date(year, month, calendar.monthrange(year, month)[1])


def _back(today: date, n: int, unit: str) -> date:
    if unit in "天日":
        return today - timedelta(days=n)
    if unit in ("周", "星期"):
        return today - timedelta(weeks=n)
    months = today.year * 12 + today.month - 1 - (n if unit == "月" else 12 * n)
    year, month = months // 12, months % 12 + 1
    return date(year, month, min(today.day, calendar.monthrange(year, month)[1]))


def _week(today: date, back: int) -> tuple[date, date]:
    monday = today - timedelta(days=today.weekday() + 7 * back)
    return monday, monday + timedelta(days=6)


def _months_ago(today: date, n: int) -> tuple[date, date]:
    d = _back(today.replace(day=1), n, "月")
    return _month(d.year, d.month)


_NAMED: dict[str, Callable[[date], tuple[date, date]]] = {
    **{w: (lambda t, n=n: (t - timedelta(days=n),) * 2) for n, w in enumerate(("今天", "昨天", "前天", "大前天"))},
    **{w: (lambda t, n=n: _week(t, n)) for n, w in enumerate(("本周", "上周", "上上周"))},
    **{w: (lambda t, n=n: _months_ago(t, n)) for w, n in (("本月", 0), ("上月", 1), ("上个月", 1), ("上上个月", 2))},
    **{w: (lambda t, n=n: (date(t.year - n, 1, 1), date(t.year - n, 12, 31))) for n, w in enumerate(("今年", "去年", "前年"))},
}


def _ymd(m, t):
    d = date(_year(m[1], t), number(m[2]) or 0, number(m[3]) or 0)
    return d, d


def _month_span(m, t):
    y = _year(m[1], t)
    return _days(_month(y, number(m[2]) or 0)[0], _month(y, number(m[3]) or 0)[1])


def _since(m, t):
    n = number(m[1])
    return _days(_back(t, n, m[2]), t) if n else None


_Y, _N, _C, _U = r"(今|去|前|大前|\d{4})年", r"(\d{1,2}|[一二三四五六七八九十]+)", r"(\d+|[一二两三四五六七八九十百]+)个?", "(天|日|周|星期|月|年)"
#: From the most to the least specific; a pattern that gives no valid period leaves the text to the next.
_PATTERNS: list[tuple[re.Pattern, Callable]] = [
    (re.compile(f"{_Y}{_N}月{_N}[日号]"), _ymd),
    (re.compile(rf"(今|去|前|大前|\d{{4}})年?{_N}月份?[到至~-]{_N}月份?"), _month_span),
    (re.compile(f"{_Y}{_N}月份?"), lambda m, t: _month(_year(m[1], t), number(m[2]) or 0)),
    (re.compile(f"前{_C}{_U}"), _since),
    (re.compile(f"{_C}{_U}前"), _since),
    (re.compile(f"最近{_C}{_U}"), _since),
    (re.compile("|".join(sorted(_NAMED, key=len, reverse=True))), lambda m, t: _NAMED[m[0]](t)),
    (re.compile(r"(\d{4})年"), lambda m, t: (date(int(m[1]), 1, 1), date(int(m[1]), 12, 31)) if 1900 <= int(m[1]) <= 2100 else None),
]

_ASKING = re.compile(r"(?:帮我|看看|想想|翻翻|回忆|回顾|搜索|查找|查看|查询|检索|找|搜|查)\s*$")
_TELLING = re.compile(r"(?:提到|谈到|说了|写了|记录了|分析了|引用了|列举了|统计了|描述|讲述|讨论|介绍|预测)\s*$")
_QUOTES = ("“”", "‘’", "《》", "〈〉", "「」", '""', "''")


def confidence(text: str, start: int, end: int) -> tuple[float, list[str]]:
    """How likely the expression at start..end restricts a search rather than belongs to what is told."""
    before, expression = text[:start].rstrip(), text[start:end]
    evidence = [
        (0.3, "+initial", not before.strip("，。！？、；： \t\n　")),
        (0.3, "+query verb", bool(_ASKING.search(before))),
        (0.1, "+的", text[end : end + 1] == "的"),
        (0.15, "+short", len(text) < 40),
        (0.1, "+relative", expression in _NAMED or expression.startswith("最近")),
        (-0.5, "-quoted", any(q[0] in text[:start] and q[1] in text[end:] for q in _QUOTES)),
        (-0.35, "-telling verb", bool(_TELLING.search(before))),
        (-0.25, "-within", any(c in before[-10:] for c in "里中内")),
        (-0.1, "-long", len(text) > 120),
    ]
    score = 0.5 + sum(w for w, _, holds in evidence if holds)
    return min(1.0, max(0.0, score)), [name for _, name, holds in evidence if holds]


@dataclass
class ParsedTime:
    time_range: tuple[float, float] | None = None
    time_expr: str | None = None
    cleaned_text: str = ""
    confidence: float | None = None
    signals: list[str] | None = None
    keywords: list[str] = field(default_factory=list)


def parse_time(text: str | None, now: datetime, threshold: float = 0.45) -> ParsedTime:
    """The period that a text's time expression denotes, the text without it, and the keywords of that.

    Below the threshold the range is None and the text is kept, but the expression is reported.
    """
    parsed = _parse(text, now, threshold)
    parsed.keywords = learnable([parsed.cleaned_text], 2, frozenset(STOPWORDS))[0]
    return parsed


def _parse(text: str | None, now: datetime, threshold: float) -> ParsedTime:
    if not isinstance(text, str) or not text:
        return ParsedTime()
    zone = now.tzinfo or timezone.utc
    for pattern, period in _PATTERNS:
        m = pattern.search(text)
        try:
            days = m and period(m, now.date())
        except (ValueError, OverflowError):
            days = None
        if days is False:
            break
        if days:
            score, signals = confidence(text, *m.span())
            if score < threshold:
                return ParsedTime(None, m[0], text.strip(), score, signals)
            left = re.sub(r"^[的，,\s]+|[的，,\s]+$", "", text[: m.start()] + text[m.end() :])
            ends = [datetime(d.year, d.month, d.day, *clock, tzinfo=zone).timestamp() for d, clock in zip(days, ((0, 0, 0), (23, 59, 59)))]
            return ParsedTime((ends[0], ends[1]), m[0], re.sub(r"\s{2,}", " ", left), score, signals)
    return ParsedTime(cleaned_text=text.strip())


def parse_column(text, now: datetime, threshold: float = 0.45):
    """A column of structs (start_ts, end_ts, time_expr, cleaned_text, confidence, signals)."""
    @F.pandas_udf("start_ts double, end_ts double, time_expr string, cleaned_text string, confidence double, signals array<string>")
    def run(s: pd.Series) -> pd.DataFrame:
        got = [_parse(t, now, threshold) for t in s]
        return pd.DataFrame(
            {
                "start_ts": [p.time_range[0] if p.time_range else None for p in got], "end_ts": [p.time_range[1] if p.time_range else None for p in got],
                "time_expr": [p.time_expr for p in got], "cleaned_text": [p.cleaned_text for p in got],
                "confidence": [p.confidence for p in got], "signals": [p.signals for p in got],
            }
        ).astype({"start_ts": "float64", "end_ts": "float64", "confidence": "float64"})

    return run(text)
