"""Personal data: patterns, and terms that disclose it by how they occur with it in the corpus.

A protected entity e (one address, one number) has the information content IC(e) = -log2 P(e), where
P(e) is the share of the documents that hold it. A term t that stands near e tells
PMI(e; t) = log2 P(e | t) / P(e) of it, where P(e | t) is the share of the documents with t that have it
near e. What it tells in proportion to IC(e) is its disclosure, 1 if t never occurs without e. Terms
beyond the thresholds are generalised or removed in the documents that hold e, so that a masked text
doesn't give away whose it was. Two documents at least must show it: of an entity that stands in one
alone nothing can be told.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclecast.llm.common import bitmap, fresh, in_bitmap, join_counted, map_batches

KINDS = ("email", "ip", "card", "phone")
#: Words (three letters or more) on each side that count as near an entity.
NEAR = 50
#: Disclosure from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.9, 0.98
#: Runs of non-space whose words a batch remembers.
MAX_RUNS = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each @, back over the local part and on over the domain, in linear time."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind as listed, then start; per kind leftmost and non-overlapping, failing ones dropped."""
    found = [("email", *x) for x in emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_DIGITS.findall(m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return found


def entity_of(kind: str, text: str) -> int:
    """A number for the entity, whatever its case."""
    return xxhash.xxh64_intdigest(text.lower().encode(), KINDS.index(kind)) >> 1


def term_key(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode(), 42) >> 1


def near_terms(text: str, spans: list[tuple[str, int, int]], wanted) -> tuple[set[tuple[int, int]], dict[int, list[tuple[int, int]]]]:
    """(entity, term) of the words near each span whose entity is ``wanted``, and all places of each
    term; words that overlap a span are none."""
    wanted_spans = [(e, a, b) for kind, a, b in spans if wanted(e := entity_of(kind, text[a:b]))]
    if not wanted_spans:
        return set(), {}
    covered = sorted((a, b) for _, a, b in spans)
    words, places, at, end = [], defaultdict(list), 0, 0  # end: the last end of the spans that begin before
    for m in _WORD.finditer(text):
        a, b = m.span()
        while at < len(covered) and covered[at][0] < b:
            end = max(end, covered[at][1])
            at += 1
        if end <= a:
            term = term_key(m[0].lower())
            words.append((a, term))
            places[term].append((a, b))
    starts, found = [a for a, _ in words], set()
    for entity, a, _ in wanted_spans:
        i = bisect_left(starts, a)
        found.update((entity, term) for _, term in words[max(0, i - NEAR) : i + NEAR])
    return found, places


def _row_keys():
    key = (F.col("doc_id").cast("long"), "text")
    return F.xxhash64(*key).alias("k1"), F.xxhash64(F.lit(1), *key).alias("k2")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_row_keys(), "text")


def found_in(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, k1, k2 (of its id and text), base spans, distinct entities."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    names = ["doc_id", "k1", "k2", "spans", "entities"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, entities = [], []
        for text in batch.column(3).to_pylist():
            own = base_spans(text or "")
            spans.append([dict(zip(("kind", "start", "end"), x)) for x in own])
            entities.append(list({entity_of(kind, text[a:b]) for kind, a, b in own}))
        columns = [*(batch.column(i) for i in range(3)), pa.array(spans, pa.list_(span)), pa.array(entities, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(_keyed(docs), run, "doc_id long, k1 long, k2 long, spans array<struct<kind: string, start: int, end: int>>, entities array<long>")


def _pairs(docs: DataFrame, recurring: tuple[bytes, int]) -> DataFrame:
    """``(entity, term, k1)``: once per row of ``docs`` for each term near one of the entities."""
    shared = docs.sparkSession.sparkContext.broadcast(recurring)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[int]] = [[], [], []]
        for key, text in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            spans = base_spans(text or "")
            for entity, term in near_terms(text, spans, lambda e: in_bitmap(shared.value, e))[0] if spans else ():
                for column, value in zip(out, (entity, term, key)):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["entity", "term", "k1"])

    return map_batches(_keyed(docs), run, "entity long, term long, k1 long")


def _documents_with(docs: DataFrame, asked: tuple[bytes, int]) -> DataFrame:
    """``(term, n)``: in how many rows each of the asked terms occurs, and others that the filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        met, known, counts = shared.value, {}, defaultdict(int)
        for text in batch.column(0).to_pylist():
            terms = set()
            for piece in set((text or "").split()):
                own = known.get(piece)
                if own is None:
                    if len(known) >= MAX_RUNS:
                        known.clear()
                    own = known[piece] = tuple(k for w in _WORD.findall(piece) if in_bitmap(met, k := term_key(w.lower())))
                if own:
                    terms.update(own)
            for term in terms:
                counts[term] += 1
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return map_batches(docs.select("text"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, tuple[bytes, int] | None]:
    """``(entity, term, both, disclosure)`` of the terms to generalise or remove, from counts over all ``docs``,
    and the filter of the entities that recur (None: none does)."""
    several = F.min("k1") != F.max("k1")
    entities = found.select(F.explode("entities").alias("entity"), "k1").groupBy("entity")
    entities = entities.agg(F.count("*").alias("entity_rows"), several.alias("several")).where("several").drop("several").checkpoint()
    none = found.sparkSession.createDataFrame([], "entity long, term long, both long, disclosure double")
    if entities.isEmpty():
        return none, None
    recurring = bitmap(entities.select(F.col("entity").alias("key")))
    near = _pairs(docs, recurring).checkpoint()
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("both"), several.alias("several"))
    rows = found.count()

    def disclosure(n: str) -> Column:
        content = F.log2(F.lit(rows) / F.col("entity_rows"))
        tells = F.log2(F.col("both") / F.col(n) / (F.col("entity_rows") / F.lit(rows)))
        return F.when(content > 0, tells / content).otherwise(F.lit(0.0))

    # a term is in as many documents at least as have it near any entity, so most can't disclose enough
    least = near.select("term", "k1").distinct().groupBy("term").agg(F.count("*").alias("near_n"))
    pairs = pairs.where("several").join(entities, "entity").join(least, "term").where(disclosure("near_n") >= GENERALISE).checkpoint()
    asked = bitmap(pairs.select(F.col("term").alias("key")).distinct())
    told = pairs.join(_documents_with(docs, asked), "term")
    return told.select("entity", "term", "both", disclosure("n").alias("disclosure")).where(F.col("disclosure") >= GENERALISE), recurring


def _places(docs: DataFrame, told: DataFrame, recurring: tuple[bytes, int]) -> DataFrame:
    """``(k1, k2, told)``: of each row that holds disclosing terms and what they disclose, their places.

    ``told`` lists start, end and disclosure of all the terms' places, by start. Repeated rows are one.
    """
    filters = docs.sparkSession.sparkContext.broadcast((recurring, bitmap(told.select(F.col("entity").bitwiseXOR(F.col("term")).alias("key")))))
    schema = "k1 long, k2 long, entity long, term long, places array<struct<start: int, end: int>>"
    place = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held, met = filters.value
        out: list[list] = [[], [], [], [], []]
        for k1, k2, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            spans = base_spans(text or "")
            pairs, places = near_terms(text, spans, lambda e: in_bitmap(held, e)) if spans else ((), {})
            for entity, term in pairs:
                if in_bitmap(met, entity ^ term):
                    for column, value in zip(out, (k1, k2, entity, term, [{"start": a, "end": b} for a, b in places[term]])):
                        column.append(value)
        columns = [*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.list_(place))]
        return pa.RecordBatch.from_arrays(columns, ["k1", "k2", "entity", "term", "places"])

    total = told.agg(F.sum("both")).first()[0] or 0
    found = join_counted(map_batches(_keyed(docs), run, schema).checkpoint(), told, ["entity", "term"], "both", total)
    terms = found.groupBy("k1", "k2", "term").agg(F.max("disclosure").alias("disclosure"), F.any_value("places").alias("places"))
    each = terms.select("k1", "k2", F.explode("places").alias("at"), "disclosure").select("k1", "k2", F.struct("at.start", "at.end", "disclosure").alias("at"))
    return each.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("at")).alias("told"))


def spans_of(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, k1, k2, spans (base ones), told (start, end, disclosure of the disclosing terms)."""
    found = found_in(docs).checkpoint()
    told, recurring = disclosing(docs, found)
    none = F.array().cast("array<struct<start: int, end: int, disclosure: double>>")
    if recurring is None:
        return found.select("doc_id", "k1", "k2", "spans", none.alias("told"))
    places = _places(docs, told.checkpoint(), recurring)
    return found.join(places, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "spans", F.coalesce("told", none).alias("told"))


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    ``spans`` lists kind:start:end of the base kinds as listed, then of ``term``, each by start, in
    code points, end exclusive. A term is near an entity within ``NEAR`` words and is told wherever it
    stands in that document. Null and empty texts have none. Repeated rows count as often in the
    corpus and get the same spans; ids may be null. An empty table gives no row.
    """
    found = spans_of(docs)
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.array_join(F.transform("spans", text), ",")
    term = F.array_join(F.transform("told", lambda x: F.concat_ws(":", F.lit("term"), x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(F.array_remove(F.transform("spans", lambda x: F.when(x["kind"] == k, 1).otherwise(0)), 0)).cast("long").alias(f"n_{k}") for k in KINDS]
    both = F.concat_ws(",", F.when(base != "", base), F.when(term != "", term))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), both.alias("spans"))


def mask(text: str, spans: list, told: list) -> str:
    """``text`` with entities as <KIND>, generalised terms as <TERM> and removed ones left out; of
    spans that overlap, all up to the last end become the first one's mask."""
    marks = [(s["start"], s["end"], f"<{s['kind'].upper()}>") for s in spans]
    marks += [(t["start"], t["end"], "" if t["disclosure"] >= REMOVE else "<TERM>") for t in told]
    out, at = [], 0
    for start, end, label in sorted(marks):
        if start >= at:
            out += [text[at:start], label]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts masked, and n_chars, if there, adjusted. Every row stays as it is otherwise."""
    found = spans_of(docs).where((F.size("spans") > 0) | (F.size("told") > 0)).dropDuplicates(["k1", "k2"]).select("k1", "k2", "spans", "told")
    names = {c: fresh(docs, f"_{c}") for c in ("k1", "k2", "spans", "told")}
    found = found.select(*(F.col(c).alias(n) for c, n in names.items()))
    keyed = docs.withColumns({names[c]: k for c, k in zip(("k1", "k2"), _row_keys())})
    joined = keyed.join(found, [names["k1"], names["k2"]], "left")

    @F.udf("string", useArrow=True)
    def masked(text, spans, told):
        return None if text is None else mask(text, spans, told)

    clean = F.col(names["spans"]).isNull()  # their texts don't go to Python
    text = F.when(clean, F.col("text")).otherwise(masked(F.when(~clean, F.col("text")), names["spans"], names["told"]))
    out = joined.withColumn("text", text)
    return (out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out).select(docs.columns)
