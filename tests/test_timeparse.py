from datetime import date, datetime, timezone

import pytest

from mnemora.functions.timeparse import number, parse_time

NOW = datetime(2026, 2, 11, 14, 30, tzinfo=timezone.utc)


def day(ts):
    return datetime.fromtimestamp(ts, timezone.utc).date()


@pytest.mark.parametrize(
    ("text", "expression", "first", "last"),
    [
        ("上周我家的小猫吃了两根火腿", "上周", date(2026, 2, 2), date(2026, 2, 8)), ("去年汽车维修的保养费是300美元", "去年", date(2025, 1, 1), date(2025, 12, 31)),
        ("前两个月你才刚作完的手术", "前两个月", date(2025, 12, 11), date(2026, 2, 11)), ("今年5月份到8月份的山姆圣诞赠礼活动", "今年5月份到8月份", date(2026, 5, 1), date(2026, 8, 31)),
        ("今天发生了什么事", "今天", date(2026, 2, 11), date(2026, 2, 11)), ("前天的会议记录", "前天", date(2026, 2, 9), date(2026, 2, 9)),
        ("前年的事情", "前年", date(2024, 1, 1), date(2024, 12, 31)), ("最近三天的新闻", "最近三天", date(2026, 2, 8), date(2026, 2, 11)),
        ("两个月前买的车", "两个月前", date(2025, 12, 11), date(2026, 2, 11)), ("2024年的旅行计划", "2024年", date(2024, 1, 1), date(2024, 12, 31)),
        ("今年5月3日的约会", "今年5月3日", date(2026, 5, 3), date(2026, 5, 3)), ("上个月的账单", "上个月", date(2026, 1, 1), date(2026, 1, 31)),
        ("上上周的会议", "上上周", date(2026, 1, 26), date(2026, 2, 1)), ("本周的工作安排", "本周", date(2026, 2, 9), date(2026, 2, 15)),
        ("本月的开支明细", "本月", date(2026, 2, 1), date(2026, 2, 28)), ("今年5月的考试", "今年5月", date(2026, 5, 1), date(2026, 5, 31)),
        ("去年12月份发生的事", "去年12月份", date(2025, 12, 1), date(2025, 12, 31)),
    ],
)
def test_ranges(text, expression, first, last):
    p = parse_time(text, NOW)
    assert (p.time_expr, day(p.time_range[0]), day(p.time_range[1])) == (expression, first, last)


@pytest.mark.parametrize(
    ("text", "accepted", "score"),
    [
        ("那篇文章里提到上周的市场波动", False, 0.25), ("报告中分析了2024年的GDP数据", False, 0.15), ("《2025年经济展望》这本书很不错", False, 0.15),
        ("他说了去年发生的一件事情", False, 0.40), ("文章里讨论今年5月的数据变化趋势", False, 0.15), ("帮我找上周的会议记录", True, 1.0),
        ("搜索2024年的报告", True, 1.0), ("查看最近三天的日志", True, 1.0), ("昨天下午的进展如何", True, 1.0), ("他引用了“去年的数据”来说明问题", False, 0.35),
    ],
)
def test_confidence(text, accepted, score):
    p = parse_time(text, NOW)
    assert bool(p.time_range) == accepted and p.confidence == pytest.approx(score)
    assert accepted or p.cleaned_text == text


@pytest.mark.parametrize("text", ["", None, "300美元的汽车保养", "这是一段没有时间词的文本", "0000年13月", "前999999年", "今年8月到5月"])
def test_no_range(text):
    assert parse_time(text, NOW).time_range is None


def test_numbers_and_cleaning():
    assert [number(s) for s in ("12", "两", "十", "十二", "二十", "二十三", "百", "")] == [12, 2, 10, 12, 20, 23, None, None]
    assert parse_time("那篇文章里提到上周的市场波动", NOW, 0.0).cleaned_text == "那篇文章里提到的市场波动"
    assert parse_time("上周的会议，记录", NOW).cleaned_text == "会议，记录"
