"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Candidate spans (anything shaped like an address, number or key) are found in whole texts.  Three
families of labelers vote on each for a kind or abstain: regular expressions on the span, gazetteers
(top-level domains, card issuers, reserved address blocks, calling codes, IBAN lengths) and words of the context.
A Dawid-Skene model, fitted by expectation-maximisation on the counts of all vote patterns of the
corpus, estimates how reliable each labeler is.  Its posteriors over a bounded sample of spans
train a softmax classifier on features of span and context, which makes the final decision.

Defined cases: null or empty texts have no spans; a null ``doc_id`` is reported as null; repeated
rows give their spans again; texts without candidates give no model and nothing is redacted; an
empty table gives an empty result; other columns, whatever their names, are carried along by
``redact`` and ignored by ``find_pii``.  Offsets count characters (code points) from 0.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.llm.common import OWN, bounded, explode_texts, map_texts, settle, table

KINDS = ["NONE", "EMAIL", "PHONE", "IP", "CARD", "SECRET", "NATIONAL_ID", "IBAN"]
_K = {k: i for i, k in enumerate(KINDS)}
#: Most spans that the final classifier is trained on.
MOST_SPANS = 20_000
_NEAR = 32

_SHAPE = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]{1,128}@[\w-]{1,64}(?:\.[\w-]{1,64})+)"
    r"|(?P<quad>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d])(?!\.\d))"
    r"|(?P<key>(?<![\w/+-])(?=[A-Za-z_/+-]*\d)(?=\d*[A-Za-z])[A-Za-z0-9_/+-]{16,}(?![\w]))"
    r"|(?P<phone>(?<![\w+])\+?\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]\d{3,4}(?!\d)"
    # Groups of two digits (fr, es), then numbers with a calling code: of two parts (de), without blanks, of more parts.
    r"|(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d|0\d)(?:[ .-]\d{2}){4}(?!\d)|(?<![\w+])(?:\+\d{1,3}[ .-])?[6-9]\d{2}(?:[ .-]\d{2}){3}(?!\d)"
    r"|(?<![\w+])\+(?:\d{1,3}[ .-]\(?\d{1,5}\)?[ ./-]?\d{4,10}|\d{8,15}|\d{1,3}[ .-]\(?\d{1,5}\)?(?:[ .-]\d{2,4}){2,4})(?!\d))"
    r"|(?P<ssn>(?<!\d)\d{3}-\d{2}-\d{4}(?!\d))"
    r"|(?P<long>(?<!\d)\d(?:[ -]?\d){12,18}(?!\d))"
    r"|(?P<number>\d+(?:[.,:/-]\d+)*)"
)
# Tokens with a digit or an at sign; blocks of four capitals, as IBANs have them, may stand between two.
# Tokens are only entered at their start and possessively, which is linear however long they are.
_HINT = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:[^\S\n]++(?:[A-Z]{4}[^\S\n]++){0,2}[^\s0-9@]*+[0-9@]\S*+)*+")
_BLOCKS = re.compile(r"(?<!\w)(?=([A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w))")
#: Generic and country top-level domains (public registry).
_DOMAINS = frozenset(
    "com org net edu gov mil int info biz name pro mobi asia cat jobs tel travel coop museum aero arpa app dev page blog shop site online tech store xyz club cloud news wiki email live world example test "
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu "
    "fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly "
    "ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz "
    "tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()
)
#: Country calling codes (ITU E.164).
_CALLING = re.compile(
    r"^\+(1|7|20|21[1-368]|22\d|23\d|24\d|25\d|26\d|27|29[0-17-9]|3[0-469]|35\d|37\d|38[0-35-79]|4[013-9]|42[013]|5[1-8]|50\d|59\d|6[0-6]|67[0-9]|68\d|69[0-2]|8[1246]|80[08]|85[02356]|870|88[0-368]|9[0-58]|96[0-8]|97\d|99[2-68])"
)
#: Issuer ranges of payment cards (ISO/IEC 7812).
_ISSUER = re.compile(r"^(4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|30[0-5]|3095|3[689]|6011|64[4-9]|65|62|35(2[89]|[3-8])|50|5[6-8]|6[37])")
#: Length of an IBAN by country (public registry).
_IBAN_LENGTHS = {
    c: n
    for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in cs.split()
}


def _reserved(a: int, b: int, c: int) -> bool:
    """Whether an address lies in a block that names no host of the internet (RFC 5735, 6598)."""
    return a >= 224 or (a, b) == (169, 254) or (a, b, c) in ((192, 0, 2), (198, 51, 100), (203, 0, 113)) or (a == 198 and b in (18, 19))


_CONTEXT = {
    "EMAIL": re.compile(r"e-?mail|contact|correo|courriel|mailto|kontakt", re.I),
    "PHONE": re.compile(r"\b(tel|phone|call|mobile|fax|telefon|t[ée]l[ée]fono?)\b", re.I),
    "IP": re.compile(r"\b(ip|host|server|address|ping)\b", re.I),
    "CARD": re.compile(r"\b(card|visa|mastercard|credit|carte|karte|tarjeta)\b", re.I),
    "SECRET": re.compile(r"\b(token|secret|api[_ -]?key|key|password|passwd|pwd|bearer)\b\W{0,6}$", re.I),
    "NATIONAL_ID": re.compile(r"\b(ssn|social security|passport|dni)\b", re.I),
    "NONE": re.compile(r"\b(version|license|v|chapter|page|section|fig(ure)?|isbn|order|part|no|copyright)\b[^\w]{0,3}$", re.I),
}
LABELERS = ["re_email", "re_quad", "re_phone", "re_card", "re_secret", "re_ssn", "re_iban", "re_plain", "gz_domain", "gz_block", "gz_calling", "gz_issuer", "cx_word", "cx_quote"]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, shape) of the candidate spans of one text, in order, without overlaps.

    Only runs of blank-separated tokens that hold a digit or an at sign are searched.
    """
    out = []
    for run in _HINT.finditer(text or ""):
        at = run.start()
        for start, end in [*_grouped_ibans(text, *run.span()), (run.end(), run.end())]:
            for m in _SHAPE.finditer(text, at, start):
                if m.lastgroup != "number" or m.end() - m.start() > 1:
                    out.append((m.start(), m.end(), m.lastgroup))
            if end > start:
                out.append((start, end, "iban"))
            at = end
    return out


def _grouped_ibans(text: str, start: int, stop: int) -> list[tuple[int, int]]:
    """(start, end) of the runs of blocks of four whose check digits are right, the longest at each place."""
    out, at = [], start
    for m in _BLOCKS.finditer(text, start, stop):
        span = m[1]
        while m.start() >= at and span:
            if _iban(span.replace(" ", "")):
                at = m.start() + len(span)
                out.append((m.start(), at))
                break
            span = span.rpartition(" ")[0]
    return out


_IBAN = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}")
_LETTER_DIGITS = {ord(c): str(int(c, 36)) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _iban(s: str) -> bool:
    if not 15 <= len(s) <= 34 or not s.isascii() or not _IBAN.fullmatch(s):
        return False
    return _IBAN_LENGTHS.get(s[:2], len(s)) == len(s) and int((s[4:] + s[:4]).translate(_LETTER_DIGITS)) % 97 == 1


def votes(text: str, start: int, end: int, shape: str) -> list[int]:
    """Each labeler's vote on a span: the index of a kind, or -1 to abstain."""
    span, before = text[start:end], text[max(0, start - _NEAR) : start]
    digits = "".join(c for c in span if c.isdigit() and c.isascii())
    quad = [int(x) for x in span.split(".")] if shape == "quad" else []
    v = [-1] * len(LABELERS)
    if shape == "email":
        v[0] = _K["EMAIL"]
        v[8] = _K["EMAIL"] if span.rpartition(".")[2].lower() in _DOMAINS else -1
    if shape == "quad":
        v[1] = _K["IP"] if max(quad) <= 255 else _K["NONE"]
        v[9] = _K["NONE"] if quad[0] in (0, 127) or quad == [255] * 4 else -1 if max(quad) > 255 or _reserved(*quad[:3]) else _K["IP"]
    if shape == "phone":
        v[2] = _K["PHONE"] if 9 <= len(digits) <= 15 else _K["NONE"]
        v[10] = _K["PHONE"] if _CALLING.match(span) else -1
    if shape == "long":
        v[3] = _K["CARD"] if luhn(digits) else _K["NONE"]
        v[11] = _K["CARD"] if luhn(digits) and _ISSUER.match(digits) else _K["NONE"]
    if shape == "key":
        varied = len(set(span.lower())) >= 8 and len(digits) >= 3
        v[4] = _K["SECRET"] if varied and len(span) >= 20 else _K["NONE"]
        v[6] = _K["IBAN"] if _iban(span) else -1
        quoted = before[-1:] in "\"'`" and before[-1:] != "" and text[end : end + 1] in "\"'`"
        v[13] = _K["SECRET"] if quoted else -1
    if shape == "iban":
        v[6] = _K["IBAN"]
    if shape == "ssn":
        v[5] = _K["NATIONAL_ID"]
    if shape == "number":
        v[7] = _K["NONE"]
    for kind, pattern in _CONTEXT.items():
        if pattern.search(before):
            v[12] = _K[kind]
    return v


SHAPES = ["email", "quad", "key", "phone", "ssn", "long", "number", "iban"]


def span_features(text: str, start: int, end: int, shape: str) -> list[float]:
    """Bounded features of a span and its context, for the final classifier."""
    span, before = text[start:end], text[max(0, start - _NEAR) : start]
    n = max(len(span), 1)
    digits = "".join(c for c in span if c.isdigit() and c.isascii())
    return [
        1.0, *(float(shape == s) for s in SHAPES), min(len(span), 64) / 32, len(digits) / n, min(len(digits), 20) / 10,
        float("@" in span), min(span.count("."), 4) / 4, float(span.startswith("+")), float("(" in span), len(set(span)) / n,
        float(shape == "long" and luhn(digits)), float(shape == "long" and bool(_ISSUER.match(digits)) and luhn(digits)),
        float(shape == "quad" and max(map(int, span.split("."))) <= 255), float(bool(_CALLING.match(span))), float(shape == "iban" or shape == "key" and _iban(span)),
        float(shape == "key" and len(set(span.lower())) >= 8 and len(span) >= 20), float(before[-1:] in ("'", '"')),
        *(float(bool(p.search(before))) for p in _CONTEXT.values()),
    ]


def fit_em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60, smooth: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dawid-Skene by EM on distinct vote patterns: (prior, P(vote | kind) per labeler, posteriors).

    Abstaining is a vote of its own (the last), as labelers abstain on most kinds but their own.
    It starts from the majority vote; ties share the mass.
    """
    k, m = len(KINDS), patterns.shape[1]
    heard = np.where(patterns < 0, k, patterns)
    post = np.full((len(patterns), k), 0.01)
    for j in range(m):
        said = patterns[:, j] >= 0
        post[np.flatnonzero(said), patterns[said, j]] += 1
    post /= post.sum(1, keepdims=True)
    for _ in range(rounds):
        mass = post * counts[:, None]
        prior = (mass.sum(0) + smooth) / (mass.sum() + smooth * k)
        confusion = np.zeros((m, k, k + 1))
        for j in range(m):
            np.add.at(confusion[j].T, heard[:, j], mass)
        # Before it has been seen a labeler is taken to be right more often than wrong.
        confusion += smooth + 2 * smooth * np.eye(k, k + 1)
        confusion /= confusion.sum(2, keepdims=True)
        log = np.tile(np.log(prior), (len(patterns), 1))
        for j in range(m):
            log += np.log(confusion[j][:, heard[:, j]]).T
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        moved = np.abs(new - post).max()
        post = new
        if moved < 1e-9:
            break
    return prior, confusion, post


def fit_softmax(x: np.ndarray, target: np.ndarray, ridge: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Softmax regression on soft targets by accelerated gradient steps."""
    w = np.zeros((x.shape[1], target.shape[1]))
    velocity, rate = np.zeros_like(w), 4.0 / max((x * x).sum(1).mean(), 1e-9)
    for t in range(steps):
        ahead = w + velocity * t / (t + 3)
        z = x @ ahead
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = ahead - rate * (x.T @ (p - target) / len(x) + ridge * ahead)
        velocity, w = new - w, new
    return w


_SPAN_FIELDS = "doc_id long, start long, end long, pattern string, x array<float>"


def _spans(docs: DataFrame) -> DataFrame:
    schema = T.StructType.fromDDL(_SPAN_FIELDS)

    def step(texts, ids):
        out = [[], [], [], [], []]
        for text, i in zip(texts, ids):
            for start, end, shape in candidates(text):
                row = (i, start, end, ",".join(map(str, votes(text, start, end, shape))), span_features(text, start, end, shape))
                for column, value in zip(out, row):
                    column.append(value)
        return out

    return explode_texts(docs.selectExpr("text", "cast(doc_id as long) doc_id"), schema, ["text", "doc_id"], lambda: step)


def train(spans: DataFrame, most: int = MOST_SPANS) -> np.ndarray | None:
    """The classifier's weights from the (written) spans of a corpus; None if it has none."""
    counts = spans.groupBy("pattern").count().orderBy("pattern").toPandas()
    if not len(counts):
        return None
    patterns = np.array([[int(v) for v in p.split(",")] for p in counts.pattern])
    _, _, post = fit_em(patterns, counts["count"].to_numpy(np.float64))
    number = {p: i for i, p in enumerate(counts.pattern)}
    rows = bounded(spans, most, "doc_id", "start", "pattern", F.col("x").cast("string")).select("pattern", "x").toPandas()
    which = np.array([number[p] for p in rows.pattern])
    return fit_softmax(np.array(rows.x.tolist(), np.float64), post[which])


def _decide(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = x @ w
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return p.argmax(1), p.max(1)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind, probability) of each span decided to be personal data."""
    spans = settle(_spans(docs))
    w = train(spans)
    out = "doc_id long, start long, end long, kind string, probability double"
    if w is None:
        return spans.select("doc_id", "start", "end", F.lit("").alias("kind"), F.lit(0.0).alias("probability")).limit(0)

    def decide(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                kind, p = _decide(np.array(batch.column("x").to_pylist(), np.float64), w)
                real = pa.array(kind > 0)
                columns = [*batch.columns[:3], pa.array([KINDS[k] for k in kind]), pa.array(p)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "end", "kind", "probability"]).filter(real)

    return spans.select("doc_id", "start", "end", "x").mapInArrow(decide, out)


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with each such span replaced by its kind in brackets; nothing else changes.

    An existing ``n_chars`` column is set to the new length of a changed text.
    """
    w = train(settle(_spans(docs)))
    if w is None:
        return docs

    def step(texts):
        out, changed = [], []
        for text in texts:
            found = candidates(text)
            if found:
                kind, _ = _decide(np.array([span_features(text, *c) for c in found]), w)
                pieces, at = [], 0
                for (start, end, _shape), k in zip(found, kind):
                    if k:
                        pieces += [text[at:start], f"[{KINDS[k]}]"]
                        at = end
                out.append("".join(pieces) + text[at:] if pieces else text)
                changed.append(bool(pieces))
            else:
                out.append(text)
                changed.append(False)
        return [out, changed]

    new, flag = f"{OWN}new", f"{OWN}changed"
    done = map_texts(docs, "text", [T.StructField(new, T.StringType()), T.StructField(flag, T.BooleanType())], lambda: step)
    columns = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(flag), F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumns(columns).drop(new, flag)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
