import math

import pytest

from mnemora.api import Memory
from mnemora.functions.tokens import TokenCounter
from mnemora.plans.prompt import pack
from mnemora.sources import files

DAY = 86400.0


def test_memory_round_trip(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"), min_cooccurrence=1)
    assert m.ingest_documents(["tariff trade china market", "tariff trade export decline", "export decline panic", "x", None]) == 3
    now = 100 * DAY
    a = m.write("trade", ["tariff", "trade"], "Tariffs rise", source="one", timestamp=now - 30 * DAY)
    b = m.write("trade", ["tariff", "market"], "Markets fall", source="two", timestamp=now - 3600, supersedes=a)
    with pytest.raises(ValueError):
        m.write()
    m.log("looked at the market", category="work", source="two", timestamp=now)
    assert m.read(a)["importance"] == 2 and m.read("mem_999999") is None and not m.set_importance("mem_999999", 3)
    assert m.set_importance(b, 10) and m.read(b)["importance"] == 5
    got = m.query(["tariff"], depth="fast", now=now)
    assert [e["id"] for e in got["matched_entries"]] == [b, a] and "Markets fall" in got["prompt_text"]
    assert m.read(b)["access_count"] == 1
    assert [e["id"] for e in m.query(["tariff"], depth="fast", now=now, source_filter="one")["matched_entries"]] == [a]
    deep = m.query(["export", "panic"], depth="deep", now=now)  # the others are too common here to have associations
    assert deep["chain"]["error"] is None and deep["expanded_keywords"]
    assert m.summarize("day", "1970-04-11")["by_category"] == {"work": 1} and len(m.recall_by_date("1970-04-11", source="two")) == 1
    m.save(str(tmp_path / "snap"))
    n = Memory.load(spark, str(tmp_path / "snap"), str(tmp_path / "n"))
    assert n.stats() == m.stats() and Memory.load(spark, str(tmp_path / "none"), str(tmp_path / "n")) is None
    assert n.remove(a) and not n.remove(a) and len(n.list_entries()) == 2
    n.consolidate(days=1, now=now)
    assert n.stats()["cooccurrence"]["total_docs"] == 0


def test_budget_is_kept():
    entries = [{"id": str(i), "topic": "t" * 30, "keywords": ["k"], "summary": "s " * 400, "body": "b " * 400, "source": "x", "timestamp": 5.0, "age_hours": i * 20.0} for i in range(3)]
    c = TokenCounter()
    for budget in (10, 60, 150, 500, 5000):
        text, loaded = pack(entries, budget, c, ["r"] * 20, ["h"], [{"path": ["a", "b"], "total_weight": 1.0}])
        assert c.count(text) <= budget * 1.1
    assert loaded["0"][-1] == "body" and "body" not in loaded["1"] and "a → b" in text


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,content\n1,"long enough, with\na line"\n2,short\n3,\n4,"   padded    "\n')
    texts = files.read_csv(spark, str(p))
    assert files.csv_counts(texts).first().asDict() == {"docs_processed": 1, "docs_skipped": 3}
    with pytest.raises(ValueError):
        files.read_csv(spark, str(p), "missing")


def test_learning_upkeep_and_statistics(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"), min_cooccurrence=1)
    assert m.stats()["matrices"] == {"dirty": True, "last_rebuild_docs": 0, "pruned_nnz": 0, "ppmi_nnz": 0}
    m.ingest_documents(["tariff trade china market", "tariff trade export decline", "export decline panic"])
    built = m.rebuild_matrices()
    # 7 words on the diagonal; pairs: 6 + 6 + 3 of which tariff-trade and export-decline occur twice
    assert (built["vocab_size"], built["pruned_nnz"]) == (7, 7 + 2 * 13)
    assert m.stats()["matrices"] == {"dirty": False, "last_rebuild_docs": 3, "pruned_nnz": 33, "ppmi_nnz": built["ppmi_nnz"]}
    words = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(30))
    m.write(summary=words, timestamp=50 * DAY)
    assert len(m.terms.where("channel = 'kw'").first().words) == 30 and m.stats()["matrices"]["dirty"]
    # tariff is in 2 of 3 texts, the other word in none
    assert m.nouns("tariff tariff panic unseen", 2) == [("tariff", round(2 * math.log(4 / 3 + 1), 6)), ("unseen", round(math.log(4 + 1), 6))]
    gone = m.cleanup_vocab(7)  # twice the row sums: panic has 2 * 3
    assert gone == 1 and m.cells.where("a = 'panic' or b = 'panic'").count() == 0 and m.cells.where("a = 'export' and b = 'export'").first().n == 2
    assert m.cleanup_vocab(7) == 0
    done = m.consolidate(days=1, now=50 * DAY + 5, min_cooccurrence=1)
    assert done["vocab_before"] == 36 and done["vocab_after"] == 30 and done["words_removed"] == 0 and done["rebuild_stats"]["vocab_size"] == 30


def test_statistics_of_a_search(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"), min_cooccurrence=1)
    now = 100 * DAY
    m.write("t", ["alpha", "beta"], "old", source="one", timestamp=now - 50 * DAY)
    m.write("t", ["alphabet"], "new", source="two", timestamp=now - 3600)
    s = m.query(["alpha"], depth="fast", now=now, time_recent=24)["search_stats"]
    assert (s["depth_used"], s["total_entries_scanned"], s["time_filtered"], s["exact_hits"], s["fuzzy_hits"], s["assoc_hits"], s["long_text_mode"]) == ("fast", 2, 1, 0, 1, 0, False)
    text = " ".join(f"alpha gamma{'abcdefghij'[i]}" for i in range(10))
    s = m.query(user_input=text, depth="fast", now=now, core_ratio=0.5, important_ratio=0.3)["search_stats"]
    assert s["long_text_mode"] and [len(s[f"{t}_keywords"]) for t in ("core", "important", "supplement")] == [5, 3, 3] and s["time_ms"] > 0
    assert m.query([], now=now)["search_stats"]["exact_hits"] == 0


def test_json_replaces_all_entries(spark, tmp_path):
    m, n = (Memory(spark, str(tmp_path / x), min_cooccurrence=1) for x in "mn")
    a = m.write("t", ["alpha", "beta"], "s", timestamp=5 * DAY, importance=4)
    m.query(["alpha"], depth="fast", now=6 * DAY)
    m.query(["beta"], depth="fast", now=7 * DAY)
    n.write("other", ["gamma"], timestamp=DAY)
    m.export_json(str(tmp_path / "json"))
    assert not n.import_json(str(tmp_path / "none")) and len(n.list_entries()) == 1
    assert n.import_json(str(tmp_path / "json")) and n.list_entries() == m.list_entries()
    assert n.read(a)["access_count"] == 2 and n.read(a)["last_accessed"] == 7 * DAY
    assert n.write("t", ["delta"], timestamp=DAY) == "mem_000002" and len(n.list_entries()) == 2


def test_csv_is_learnt_on_executors(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("content\n" + "".join(f"some words of row{chr(97 + i)}\n" for i in range(5)) + "short\n单独的中文文本在这里也要学习\n")
    m, told = Memory(spark, str(tmp_path / "m"), min_cooccurrence=1), []
    m.ingest_documents(["first text learnt"])
    got = m.ingest_csv(str(p), progress=lambda *x: told.append(x))
    assert (got["docs_processed"], got["docs_skipped"]) == (6, 1) and told == [(0, 7), (6, 7)]
    terms = m.terms.orderBy("doc_seq").collect()
    assert [t.doc_seq for t in terms] == list(range(1, 8)) and terms[6].words[0] == "单独" and m.stats()["cooccurrence"]["total_docs"] == 7


def test_parsed_time_has_keywords():
    from datetime import datetime, timezone

    from mnemora.functions.timeparse import parse_time

    p = parse_time("昨天 trade report", datetime(2024, 2, 1, tzinfo=timezone.utc))
    assert p.cleaned_text == "trade report" and p.keywords == ["report", "trade"]
