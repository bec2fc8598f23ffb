"""A stateful facade over the operators, for one writer.

State is a list of tables in a folder: the operation log and the terms to learn from, to which
small batches are appended as Parquet files; everything else is derived from them when asked for.
"""

from __future__ import annotations

import math
import re
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora import schema
from mnemora.functions import text as X
from mnemora.functions.lexer import learnable
from mnemora.functions.scoring import retention
from mnemora.functions.stopwords import STOPWORDS
from mnemora.functions.timeparse import parse_time
from mnemora.functions.tokens import TokenCounter
from mnemora.operators import assoc, cooc, episodic, graph, search, store
from mnemora.plans import prompt, retrieve
from mnemora.session import settle
from mnemora.sources import files

_FIELDS = [f.name for f in schema.ENTRY.fields]
_STOP = frozenset(STOPWORDS)


class Memory:
    def __init__(self, spark: SparkSession, path: str, min_cooccurrence: int = 5, decay_rate: float = 0.005, decay_interval: int = 500, time_decay: float = 0.1, vocabulary: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.min_cooccurrence, self.decay_rate, self.decay_interval, self.time_decay = min_cooccurrence, decay_rate, decay_interval, time_decay
        self.counter = TokenCounter(vocabulary)
        self._seq = self._next = self._docs = 0
        self._parts = {"ops": [], "terms": []}
        self._matrices: dict | None = None  # None: what was learnt since isn't in them

    # ---- state ----

    def _append(self, table: str, rows: list, kind) -> None:
        part = f"{self.path}/{table}/{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, kind).coalesce(1).write.parquet(part)
        self._parts[table].append(part)

    def _table(self, name: str, kind) -> DataFrame:
        parts = self._parts[name]
        return self.spark.read.schema(kind).parquet(*parts) if parts else self.spark.createDataFrame([], kind)

    @property
    def ops(self) -> DataFrame:
        return self._table("ops", schema.OPS)

    @property
    def terms(self) -> DataFrame:
        return self._table("terms", schema.TERMS)

    @property
    def entries(self) -> DataFrame:
        return store.current_entries(self.ops)

    @property
    def cells(self) -> DataFrame:
        """All cells with decay, folded from the terms."""
        return cooc.decayed(self.terms, self.decay_rate, self.decay_interval, self._docs)

    def rebuild_matrices(self, min_cooccurrence: int | None = None) -> dict:
        """Write the pruned cells and their association scores, from which questions are answered until more is learnt."""
        began = time.time()
        least = self.min_cooccurrence if min_cooccurrence is None else min_cooccurrence
        cells = settle(self.cells)
        pruned = settle(cooc.prune(cells, least))
        scores = settle(assoc.ppmi(pruned, self._docs))
        nnz = lambda m: m.agg(F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(2)), F.lit(0))).first()[0]
        self._matrices = {"pruned": pruned, "scores": scores, "docs": self._docs, "pruned_nnz": nnz(pruned), "ppmi_nnz": nnz(scores)}
        return {"vocab_size": cells.where("a = b").count(), "pruned_nnz": self._matrices["pruned_nnz"], "ppmi_nnz": self._matrices["ppmi_nnz"], "time_ms": (time.time() - began) * 1000}

    def _matrix(self, name: str) -> DataFrame:
        if self._matrices is None:
            self.rebuild_matrices()
        return self._matrices[name]

    @property
    def scores(self) -> DataFrame:
        return self._matrix("scores")

    def _learn(self, part: str) -> None:
        self._parts["terms"].append(part)
        self._matrices = None

    def _log(self, *ops: tuple) -> None:
        rows = []
        for op, entry_id, ts, level, payload in ops:
            self._seq += 1
            rows.append((self._seq, op, entry_id, ts, level, payload))
        self._append("ops", rows, schema.OPS)

    # ---- learning ----

    def _keywords(self, texts: list[str]) -> list[list[str]]:
        return learnable(texts, 2, _STOP)

    def nouns(self, text: str, top_k: int = 20) -> list[tuple[str, float]]:
        """The words of a text with their TF-IDF weights, the greatest first; no part-of-speech filter is available.

        Document frequencies are those of what was learnt; contained words are dropped before the cut.
        """
        words = self._keywords([text])[0]
        if not words:
            return []
        asked = self.spark.createDataFrame([(w,) for w in words], "a string")
        df = {r.a: r.n for r in asked.join(self._matrix("pruned").where("a = b"), "a").select("a", "n").collect()} if self._docs else {}
        low = text.lower()
        weight = {w: round(len(re.findall(re.escape(w), low)) * math.log((self._docs + 1) / (df.get(w, 0) + 1) + 1), 6) for w in words}
        return sorted(weight.items(), key=lambda x: (-x[1], x[0]))[:top_k]

    def ingest_documents(self, texts: list[str | None]) -> int:
        """Learn from texts; those without two keywords count for nothing."""
        rows = []
        for words in self._keywords([t for t in texts if isinstance(t, str) and t]):
            if len(words) >= 2:
                self._docs += 1
                rows.append((self._docs, "doc", words))
        if rows:
            self._append("terms", rows, schema.TERMS)
            self._matrices = None
        return len(rows)

    def ingest_csv(self, path: str, content_column: str = "content", progress: Callable[[int, int], None] | None = None, multi_line: bool = True) -> dict:
        """Learn from a column of CSV files, on the executors; ``progress`` is told (processed, total) when they are read and at the end."""
        began = time.time()
        texts = files.read_csv(self.spark, path, content_column, multi_line).select("text")
        counts = files.csv_counts(texts).first()
        total = counts.docs_processed + counts.docs_skipped
        if progress:
            progress(0, total)
        kept = files.long_enough(texts).withColumn("at", F.monotonically_increasing_id())
        learnt = cooc.enough_words(kept.select("at", X.learnable_words("text").alias("words")))
        numbered = cooc.number_documents(learnt, "at").select((F.col("doc_seq") + self._docs).cast("long").alias("doc_seq"), F.lit("doc").alias("channel"), "words")
        part = f"{self.path}/terms/{uuid.uuid4().hex}"
        numbered.write.parquet(part)
        self._docs += self.spark.read.schema(schema.TERMS).parquet(part).count()
        self._learn(part)
        if progress:
            progress(counts.docs_processed, total)
        return {"docs_processed": counts.docs_processed, "docs_skipped": counts.docs_skipped, "seconds": time.time() - began}

    # ---- entries ----

    def write(self, topic=None, keywords=None, summary=None, body=None, source=None, category=None, entry_type="knowledge", importance=3, timestamp=None, supersedes=None, auto_extract=True, episodic_log=False) -> str:
        if not (topic or keywords or summary or body):
            raise ValueError("an entry needs a topic, keywords, a summary or a body")
        given = list(dict.fromkeys(keywords or []))
        learnt = given
        if not given and auto_extract:
            given = self._keywords([" ".join(x for x in (topic, summary, (body or "")[:500]) if x)])[0]
            nouns = [w for w, _ in self.nouns(" ".join([*(x for x in (topic,) if x), *given, *(x for x in (summary,) if x)]))]
            learnt = list(dict.fromkeys(nouns + given))
        ts = float(time.time() if timestamp is None else timestamp)
        self._next += 1
        entry_id = f"mem_{self._next:06d}"
        day = datetime.fromtimestamp(ts, timezone.utc).date().isoformat()
        payload = (entry_type, topic, summary, body, source, category, given or None, ts, day, min(5, max(1, importance)), supersedes, episodic_log)
        ops = [("add", entry_id, ts, None, payload)]
        if supersedes:
            ops.append(("demote", supersedes, ts, None, None))
        self._log(*ops)
        if len(learnt) >= 2:
            self._append("terms", [(self._docs, "kw", learnt)], schema.TERMS)
            self._matrices = None
        return entry_id

    def log(self, content: str, detail=None, category=None, tags=None, source=None, timestamp=None, importance=3) -> str:
        if not content or not content.strip():
            raise ValueError("a log needs content")
        return self.write(category, tags, content, detail, source, category, "log", importance, timestamp, episodic_log=True)

    def read(self, entry_id: str) -> dict | None:
        r = self.entries.where(F.col("id") == entry_id).first()
        return r and r.asDict()

    def remove(self, entry_id: str) -> bool:
        if self.read(entry_id) is None:
            return False
        self._log(("remove", entry_id, None, None, None))
        return True

    def set_importance(self, entry_id: str, level: int) -> bool:
        if self.read(entry_id) is None:
            return False
        self._log(("set_imp", entry_id, None, level, None))
        return True

    def list_entries(self, source=None, entry_type=None) -> list[dict]:
        return [r.asDict() for r in store.list_entries(self.entries, source, entry_type).collect()]

    # ---- asking ----

    def query(
        self, keywords=None, user_input=None, depth="standard", token_budget=1000, time_recent=None, time_range=None, source_filter=None, top_expand=10, top_entries=10,
        chain_fuzzy=False, auto_parse_time=False, long_threshold=80, now=None, core_ratio=0.2, important_ratio=0.4,
    ) -> dict:
        began = time.time()
        now = float(time.time() if now is None else now)
        parsed = None
        if auto_parse_time and user_input and not time_recent and not time_range:
            parsed = parse_time(user_input, datetime.fromtimestamp(now, timezone.utc))
            if parsed.time_range:
                time_range, user_input = parsed.time_range, parsed.cleaned_text
        rows = [("q", w, "core") for w in dict.fromkeys(keywords or [])]
        long = bool(user_input) and len(user_input) > long_threshold
        if user_input:
            own = {w for _, w, _ in rows}
            if long:
                texts = self.spark.createDataFrame([("q", user_input)], "query_id string, text string")
                tiers = retrieve.query_words(texts, long_threshold=long_threshold, core_ratio=core_ratio, important_ratio=important_ratio)
                rows += [("q", r.word, r.tier) for r in tiers.collect() if r.word not in own]
            else:
                rows += [("q", w, "core") for w in self._keywords([user_input])[0] if w not in own]
        entries = settle(self.entries)
        stats = {"depth_used": depth, "total_entries_scanned": entries.count(), "time_filtered": 0, "exact_hits": 0, "fuzzy_hits": 0, "assoc_hits": 0, "long_text_mode": long}
        if long:
            stats |= {f"{t}_keywords": [w for _, w, x in rows if x == t] for t in ("core", "important", "supplement")}
        parsed = parsed if parsed and parsed.time_range else None
        if not rows:
            stats["time_ms"] = (time.time() - began) * 1000
            return {"prompt_text": "", "matched_entries": [], "expanded_keywords": [], "chain": None, "parsed_time": parsed, "search_stats": stats}
        q = self.spark.createDataFrame(rows, "query_id string, word string, tier string")
        scores = self.scores if depth in ("standard", "deep") and self._docs else None
        core = [w for _, w, t in rows if t == "core"]
        chain, chain_words = None, None
        if depth == "deep" and len(core) >= 2 and scores is not None:
            chain = self.find_chain(core)
            top = [h["word"] for h in chain["hidden_words"][:5]]
            chain_words = self.spark.createDataFrame([("q", w) for w in top], "query_id string, word string") if top else None
        found = retrieve.find(q, entries, now, scores, depth, chain_words, chain_fuzzy, source_filter, time_recent, time_range, top_expand)
        hits = settle(found.hits)
        for r in hits.agg(*(F.count_if(F.col(c) > 0).alias(f"{c}_hits") for c in ("exact", "fuzzy", "assoc"))).collect():
            stats |= r.asDict()
        if time_range or time_recent:
            of_source = entries if source_filter is None else entries.where(F.col("source") == source_filter)
            stats["time_filtered"] = of_source.count() - found.pool.count()
        got = search.score(hits, found.pool, now, top_entries, self.time_decay, found.supplement)
        ranked = got.join(entries.drop("importance"), got.entry_id == entries.id).orderBy("rank").collect()
        expanded = [r.word for r in found.expanded.orderBy("rank").collect()] if found.expanded is not None else []
        matched = [r.asDict() for r in ranked]
        if matched:
            self._log(*(("access", m["id"], now, None, None) for m in matched))
        text, loaded = prompt.pack(matched, token_budget, self.counter, expanded, [h["word"] for h in chain["hidden_words"]] if chain else [], chain["chains"] if chain else [])
        stats["time_ms"] = (time.time() - began) * 1000
        return {"prompt_text": text, "loaded": loaded, "matched_entries": matched, "expanded_keywords": expanded, "chain": chain, "parsed_time": parsed, "search_stats": stats}

    def find_chain(self, anchors: list[str], top_k: int = 50, alpha: float = 0.85, min_edge_weight: float = 0.1, top_n: int = 10, with_evidence: bool = False) -> dict:
        words, chains, error = graph.hidden_chain(self.scores, self._matrix("pruned"), anchors, top_k, alpha, min_edge_weight, top_n)
        hidden = [r.asDict() for r in words.collect()]
        if with_evidence and hidden:
            entries = self.entries
            found = {r.word: r.asDict() for r in search.evidence(words, store.keyword_index(entries), entries).collect()}
            for h in hidden:
                h["evidence"] = found.get(h["word"])
        return {"hidden_words": hidden, "chains": [r.asDict() for r in chains.collect()], "error": error}

    def recall_by_date(self, day: str, **filters) -> list[dict]:
        return self.recall_by_range(day, day, **filters)

    def recall_by_range(self, start: str, end: str, **filters) -> list[dict]:
        return [r.asDict() for r in episodic.recall(self.entries, start, end, **filters).collect()]

    def summarize(self, period: str, end: str) -> dict:
        """Counts of a period by day and category, and its logs, the oldest first."""
        entries = settle(self.entries)
        rows = episodic.summarize(entries, period, end).collect()
        by_day: dict = {}
        for r in sorted((r for r in rows if r.date_str and r.category), key=lambda r: (r.date_str, r.category)):
            by_day.setdefault(r.date_str, {})[r.category] = r.n
        bounds = episodic.period_bounds(period, end)
        return {
            "period": " ~ ".join(bounds), "period_type": period,
            "total": sum(r.n for r in rows if r.date_str is None and r.category is None), "by_day": by_day,
            "by_category": {r.category: r.n for r in rows if r.date_str is None and r.category is not None},
            "entries": [r.asDict() for r in episodic.recall(entries, *bounds).collect()],
        }

    # ---- upkeep ----

    def cleanup_vocab(self, least: float | None = None, max_vocab: int | None = None) -> int:
        """Forget rare words and those beyond the vocabulary's limit for good; the number of words forgotten."""
        gone = settle(cooc.cleanup(settle(self.cells), self.min_cooccurrence if least is None else least, max_vocab))
        n = gone.count()
        if n:
            part = f"{self.path}/terms/{uuid.uuid4().hex}"
            cooc.forget_words(self.terms, gone).write.parquet(part)
            self._parts["terms"] = []
            self._learn(part)
        return n

    def consolidate(self, days: float | None = None, now: float | None = None, min_cooccurrence: int | None = None, max_vocab: int | None = None) -> dict:
        """Forget rare words, rebuild the matrices and save all beside the data.

        With ``days`` all that was learnt is forgotten first, and learnt anew from the keyword lists of
        recent entries.
        """
        vocabulary = lambda: self.cells.where("a = b").count()
        before = vocabulary()
        if days:
            now = float(time.time() if now is None else now)
            recent = store.entries_since(self.entries, now - days * 86400).where(F.size(F.array_distinct("keywords")) >= 2)
            part = f"{self.path}/terms/{uuid.uuid4().hex}"
            recent.select(F.lit(0).cast("long").alias("doc_seq"), F.lit("kw").alias("channel"), F.array_distinct("keywords").alias("words")).write.parquet(part)
            self._parts["terms"], self._docs = [], 0
            self._learn(part)
        removed = self.cleanup_vocab(min_cooccurrence, max_vocab)
        rebuilt = self.rebuild_matrices(min_cooccurrence)
        self.save(f"{self.path}/snapshot-{uuid.uuid4().hex}")
        return {"vocab_before": before, "vocab_after": vocabulary(), "words_removed": removed, "rebuild_stats": rebuilt}

    def export_json(self, path: str) -> None:
        files.export_entries(self.entries, path, self._next)

    def import_json(self, path: str) -> bool:
        """Replace all entries by exported ones; False, and nothing changes, if there are none."""
        got = files.import_entries(self.spark, path)
        if got is None:
            return False
        entries, self._next = got
        numbered = settle(cooc.number_documents(entries, "id"))
        payload = F.struct(*(F.col(f) for f in _FIELDS))
        add = numbered.select((2 * F.col("doc_seq")).alias("seq"), F.lit("add").alias("op"), F.col("id").alias("entry_id"), F.col("timestamp").alias("ts"), F.lit(None).cast("int").alias("level"), payload.alias("payload"))
        seen = numbered.where("access_count > 0").select(
            (2 * F.col("doc_seq") + 1).alias("seq"), F.lit("access").alias("op"), F.col("id").alias("entry_id"), F.col("last_accessed").alias("ts"), F.col("access_count").cast("int").alias("level")
        )
        part = f"{self.path}/ops/{uuid.uuid4().hex}"
        add.unionByName(seen, allowMissingColumns=True).write.parquet(part)
        self._parts["ops"], self._seq = [part], 2 * numbered.count() + 1
        return True

    def stats(self) -> dict:
        entries = settle(self.entries)
        s, c = store.store_stats(entries, store.keyword_index(entries)).first(), cooc.stats(self.cells, self._docs).first()
        kept = self.spark.range(1).select(retention(self.decay_rate, F.lit(float(self._docs // self.decay_interval)))).first()[0]
        logs = entries.where("is_episodic")
        days = logs.agg(F.count("*").alias("n"), F.countDistinct("date_str").alias("d")).first()
        matrices = self._matrices or {}
        return {
            "config": self._config(), "store": s.asDict(), "cooccurrence": c.asDict(), "decay": {"steps": self._docs // self.decay_interval, "retention": kept},
            "matrices": {"dirty": self._matrices is None, "last_rebuild_docs": matrices.get("docs", 0), "pruned_nnz": matrices.get("pruned_nnz", 0), "ppmi_nnz": matrices.get("ppmi_nnz", 0)},
            "episodic": {"total_logs": days.n, "total_days": days.d, "categories": {r.category: r.n for r in episodic.category_counts(logs.where("topic is not null")).collect()}},
        }

    def _config(self) -> dict:
        return {"min_cooccurrence": self.min_cooccurrence, "decay_rate": self.decay_rate, "decay_interval": self.decay_interval, "time_decay": self.time_decay}

    def save(self, path: str) -> None:
        """Operations, terms, and the matrices if they are up to date."""
        tables, m = {"ops": self.ops, "terms": self.terms}, self._matrices
        if m:
            tables |= {"pruned": m["pruned"], "scores": m["scores"]}
        config = {"seq": self._seq, "next": self._next, "docs": self._docs, "matrices": m and {k: m[k] for k in ("docs", "pruned_nnz", "ppmi_nnz")}}
        files.save_snapshot(path, tables, config | self._config())

    @classmethod
    def load(cls, spark: SparkSession, snapshot: str, path: str) -> Memory | None:
        got = files.load_snapshot(spark, snapshot, ["ops", "terms"])
        if got is None:
            return None
        _, c = got
        m = cls(spark, path, c["min_cooccurrence"], c["decay_rate"], c["decay_interval"], c["time_decay"])
        m._seq, m._next, m._docs = c["seq"], c["next"], c["docs"]
        m._parts = {"ops": [f"{snapshot}/ops"], "terms": [f"{snapshot}/terms"]}
        if c["matrices"]:
            m._matrices = c["matrices"] | {name: spark.read.parquet(f"{snapshot}/{name}") for name in ("pruned", "scores")}
        return m
