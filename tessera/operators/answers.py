"""Answers from evidence: which sentence answers, what supports it, whether it is enough, and how it is cited.

Evidence has a place in its query's pack (`place`, from 1), which settles ties.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tessera.functions import text as T
from tessera.operators.context import SUPERSCRIPTS
from tessera.runtime import ship

# Terms that say nothing about what is asked, or of an answer; sentences of the reply; prefixes of summaries that say nothing.
GENERIC = ("这个", "那个", "这里", "那里", "什么", "哪些", "一下", "请问", "请", "how", "what", "which", "where", "why", "when", "this", "that", "these", "those", "the", "a", "an")
GENERIC_ANSWER = ("什么", "哪些", "哪里", "一下", "这个", "那个", "这里", "那里", "请问", "请", "how", "what", "which", "where", "why", "when", "this", "that", "these", "those", "document", "doc", "source")
NO_EVIDENCE = "Insufficient evidence in indexed sources."
INSUFFICIENT = "当前证据不足，无法给出可靠回答。"
EMPTY_PREFIXES = ("this section discusses", "this section describes", "this section explains", "the section discusses", "the section describes", "the text discusses", "the text describes")
FOOTNOTES = "\n\n⁣——\n"
ALIAS = r"\[(Doc-\d+)\]"
OTHER_CITATION = r"\[(?:doc[-_]?)?(\d+)[:：,._](\d+)\]|\[section[-_]?(\d+)\]"


def focus_terms(text: Column | str, generic: Sequence[str] = GENERIC, least: int = 1) -> Column:
    """Distinct terms that are not generic and have `least` characters, or all terms if none is left."""
    every = T.search_terms(text)
    kept = F.filter(every, lambda t: ~t.isin(*generic) & (F.length(t) >= least))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def search_text(text: Column, anchor: Column, path: Column) -> Column:
    """What evidence is matched by: text, anchor and path."""
    return F.array_join(F.filter(F.array(*(F.coalesce(c, F.lit("")) for c in (text, anchor, F.array_join(F.coalesce(path, F.array().cast("array<string>")), " ")))), lambda x: x != ""), " ")


# --- enough evidence, and which ----------------------------------------------------------------


def insufficient(queries: DataFrame, evidence: DataFrame, least: int = 2) -> DataFrame:
    """query_id, insufficient of queries (query_id, query), given evidence (query_id, text, anchor, path).

    Evidence without text doesn't count. It is enough if all of it together has `least` of the
    query's terms, or some of it has one; a query without terms has enough with any.
    """
    found = evidence.where(F.trim("text") != "").select("query_id", search_text(F.col("text"), F.col("anchor"), F.col("path")).alias("s"))
    terms = queries.select("query_id", focus_terms("query").alias("terms"))
    shared = found.join(terms, "query_id").select("query_id", F.array_intersect("terms", T.search_terms("s")).alias("x"), F.size("terms").alias("n"))
    per = shared.groupBy("query_id").agg(F.size(F.array_distinct(F.flatten(F.collect_set("x")))).alias("together"), F.max(F.size("x")).alias("best"), F.max("n").alias("n"))
    short = (F.col("n") > 0) & (F.col("together") < least) & (F.col("best") < 1)
    return queries.select("query_id").join(per, "query_id", "left").select("query_id", F.coalesce(short, F.lit(True)).alias("insufficient"))


def supporting(answers: DataFrame, evidence: DataFrame, most: int = 2) -> DataFrame:
    """query_id, evidence_id, place of what supports answers (query_id, answer): the `most` items with most terms in common.

    If none has any, the first by the same order stands alone. evidence: query_id, evidence_id, text, anchor, path, score, place.
    """
    terms = answers.select("query_id", focus_terms("answer").alias("focus"), T.search_terms("answer").alias("terms"))
    e = evidence.join(terms, "query_id")
    e = e.withColumn("a", T.keyword_overlap(F.col("focus"), search_text(F.col("text"), F.col("anchor"), F.col("path")))).withColumn("b", T.keyword_overlap(F.col("terms"), "text"))
    by = Window.partitionBy("query_id").orderBy(F.desc("a"), F.desc("b"), F.desc("score"), "place")
    ranked = e.withColumn("r", F.row_number().over(by))
    return ranked.where((F.col("r") == 1) | ((F.col("r") <= most) & (F.col("a") > 0))).select("query_id", "evidence_id", F.col("r").alias("place"))


# --- what answers ------------------------------------------------------------------------------


def fragment(text: Column) -> Column:
    """A sentence without back-ticks and its last mark, white space collapsed."""
    flat = T.normalize_whitespace(F.replace(text, F.lit("`"), F.lit("")))
    return F.trim(F.regexp_replace(flat, "[。！？.!?]$", ""))


def _first_with_text(evidence: DataFrame, hits: int) -> DataFrame:
    """The first `hits` items of each query that have text."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return evidence.where(F.trim("text") != "").withColumn("__n", nth).where(F.col("__n") <= hits).drop("__n")


def best_sentences(queries: DataFrame, evidence: DataFrame, hits: int = 6) -> DataFrame:
    """query_id, answer: of the sentences of the first `hits` items with text the one that has the query, most of its focus terms and of its terms.

    Commands aren't answers unless there is nothing else. queries: query_id, query, focus (terms; those
    of the query where empty or null), needs_structure. Evidence without a sentence answers with its first text.
    """
    asked = queries.select(
        "query_id", F.lower(T.strip("query")).alias("q"), T.search_terms("query").alias("terms"), "needs_structure",
        F.when(F.size(F.coalesce("focus", F.array().cast("array<string>"))) > 0, F.col("focus")).otherwise(focus_terms("query", GENERIC_ANSWER, 2)).alias("focus"),
    )
    e = _first_with_text(evidence, hits).join(asked, "query_id")
    s = e.select("*", F.posexplode(T.sentences("text")).alias("n", "sentence"))
    focus, plain = T.keyword_overlap(F.col("focus"), "sentence"), ~T.looks_command_like("sentence")
    exact = (F.col("q") != "") & F.contains(F.lower("sentence"), F.col("q"))
    key = [plain.cast("int"), exact.cast("int"), F.when(F.col("needs_structure"), focus).otherwise(0), focus, T.keyword_overlap(F.col("terms"), "sentence")]
    best = F.max_by("sentence", F.struct(*(k.alias(f"k{i}") for i, k in enumerate(key)), (-F.col("place")).alias("p"), (-F.col("n")).alias("m")))
    first = evidence.where(F.trim("text") != "").groupBy("query_id").agg(F.min_by("text", "place").alias("whole"))
    return first.join(s.groupBy("query_id").agg(best.alias("sentence")), "query_id", "left").select("query_id", F.coalesce("sentence", "whole").alias("answer"))


def structure_leads(queries: DataFrame, evidence: DataFrame, hits: int = 8) -> DataFrame:
    """query_id, answer: the lead of the item whose anchor, then text, has most of the focus terms; its first sentence with one of them, else its first that is no command."""
    e = _first_with_text(evidence, hits).join(queries.select("query_id", "focus"), "query_id")
    s = e.select("*", T.sentences("text").alias("ss"))
    usable = F.filter("ss", lambda x: ~T.looks_command_like(x))
    named = F.filter(usable, lambda x: T.keyword_overlap(F.col("focus"), x) > 0)
    lead = fragment(F.coalesce(F.get(named, F.lit(0)), F.get(usable, F.lit(0))))
    anchor = T.keyword_overlap(F.col("focus"), "anchor")
    key = F.struct(anchor.alias("a"), T.keyword_overlap(F.col("focus"), "text").alias("b"), F.col("score").alias("c"), (-F.col("place")).alias("d"))
    return s.withColumn("lead", lead).where(F.length("lead") > 0).groupBy("query_id").agg(F.max_by("lead", key).alias("answer"))


def special_leads(queries: DataFrame, evidence: DataFrame, hits: int = 8) -> DataFrame:
    """query_id, answer: the text of the best item whose record type is a target of the query."""
    e = _first_with_text(evidence, hits).join(queries.select("query_id", "targets"), "query_id").where(F.array_contains("targets", F.col("record_type")))
    return e.groupBy("query_id").agg(F.max_by(T.strip("text"), F.struct("score", (-F.col("place")).alias("p"))).alias("answer"))


def grounded_candidates(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, answer of every query: by its targets, by structure where it asks for that, else the best sentence; the fixed reply without evidence."""
    special = special_leads(queries, evidence).withColumnRenamed("answer", "a")
    structure = structure_leads(queries.where("needs_structure"), evidence).withColumnRenamed("answer", "b")
    best = best_sentences(queries, evidence).withColumnRenamed("answer", "c")
    out = queries.select("query_id").join(special, "query_id", "left").join(structure, "query_id", "left").join(best, "query_id", "left")
    return out.select("query_id", F.coalesce("a", "b", "c", F.lit(NO_EVIDENCE)).alias("answer"))


# --- grounded or not ---------------------------------------------------------------------------


def plain_claim(text: Column) -> Column:
    """A text without emphasis, markers in brackets and list signs, white space collapsed."""
    out = text
    for a, b in ((r"\*\*|__|`", " "), (r"\[(Doc-\d+|[^\[\]]+:[^\[\]]+|[^\[\]]+)\]", " "), (r"(?m)^\s*[-*]\s*", ""), (r"(?m)^\s*\d+\.\s*", "")):
        out = F.regexp_replace(out, a, b)
    return T.normalize_whitespace(out)


def claims_supported(answer: Column, evidence: Column) -> Column:
    """Whether each sentence of an answer is in one of the texts of `evidence` (an array), or shares half of its terms, two at least, with one or with all together."""
    texts = F.filter(F.transform(evidence, plain_claim), lambda t: t != "")
    known = F.transform(texts, lambda t: F.struct(t.alias("t"), T.search_terms(t).alias("x")))
    together = T.search_terms(F.array_join(texts, " "))

    def held(s: Column) -> Column:
        terms = T.search_terms(s)
        need = F.greatest(F.lit(2), F.floor((F.size(terms) + 1) / 2))
        enough = lambda x: (F.size(terms) > 0) & (F.size(F.array_intersect(terms, x)) >= need)
        return F.exists(known, lambda e: F.contains(e["t"], s) | enough(e["x"])) | enough(together)

    plain = plain_claim(answer)
    return (plain != "") & (F.size(texts) > 0) & F.forall(T.sentences(plain), held)


def support_score(answer: Column, evidence: Column) -> Column:
    """The share of an answer's focus terms that the evidence has; 1 for a text without terms, 0 for none."""
    terms = focus_terms(answer)
    share = T.keyword_overlap(terms, evidence) / F.size(terms)
    return F.when(F.size(terms) > 0, share).otherwise((F.trim(answer) != "").cast("double"))


# --- references and citations ------------------------------------------------------------------


def reference(doc_id: Column, section_id: Column, asset_id: Column) -> Column:
    """[document:section], [document:asset] or [document]."""
    part = F.coalesce(section_id.cast("string"), asset_id.cast("string"))
    return F.concat(F.lit("["), doc_id.cast("string"), F.coalesce(F.concat(F.lit(":"), part), F.lit("")), F.lit("]"))


def with_references(text: Column, references: Column, aliases: Column) -> Column:
    """A text with its [Doc-n] markers replaced by `aliases` (a map, others go), and the first two references added if it has none of them."""
    marks = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[Doc-\d+\]"), F.lit(0)))
    swapped = F.aggregate(marks, T.strip(text), lambda t, m: F.replace(t, m, F.coalesce(F.try_element_at(aliases, F.substring(m, F.lit(2), F.length(m) - 2)), F.lit(""))))
    tidy = T.strip(F.regexp_replace(swapped, r"\s{2,}", " "))
    own = F.array_distinct(references)
    has = F.exists(own, lambda r: F.contains(tidy, r))
    return F.when((tidy == "") | (F.size(own) == 0) | has, tidy).otherwise(F.concat(tidy, F.lit(" "), F.array_join(F.slice(own, 1, 2), "")))


def _raised(n: int) -> str:
    return str(n).translate(str.maketrans("0123456789", SUPERSCRIPTS))


def _source(c: dict) -> str:
    where = " > ".join(c.get("section_path") or ()) or c.get("citation_anchor")
    first, last = c.get("page_start"), c.get("page_end")
    page = None if first is None else f"p.{first}" + (f"-{last}" if last not in (None, first) else "")
    return " — ".join(str(x) for x in (c.get("file_name"), where, page) if x)


def format_answer(text: str, links: Sequence[str], citations: Sequence[dict]) -> tuple[str, str, str, int]:
    """(body, footnotes, both, citations): markers of links become raised numbers in order of first use, with a footnote each.

    `links` are the evidence ids that Doc-1, Doc-2... stand for; other ways of citing are brought to
    these first. A marker of evidence that is unknown, or that has a number under another marker, goes.
    Without markers the links are numbered as they are.
    """
    if not citations:
        return text, "", text, 0
    cited = {c["evidence_id"]: c for c in reversed(citations)}
    links = list(links)

    def marker(m: re.Match) -> str:
        n = int(m[2] or m[3])
        same = [i for i, e in enumerate(links) if e in cited and (i + 1 == n or e == f"E{n}")]
        return f"[Doc-{(same[0] if same else (n - 1) % len(links)) + 1}]"

    if links:
        text = re.sub(OTHER_CITATION, marker, text)
    numbers, order = {}, []
    marks = list(dict.fromkeys(re.findall(ALIAS, text)))
    for mark in marks:
        n = int(mark[4:])
        evidence = links[n - 1] if 0 < n <= len(links) else None
        if evidence and evidence not in order:
            order.append(evidence)
            numbers[mark] = len(order)
    if not marks:
        order = list(dict.fromkeys(e for e in links if e))
    body = text
    if marks:
        body = re.sub(ALIAS, lambda m: _raised(numbers[m[1]]) if m[1] in numbers else "", text)
    if marks or order:
        body = re.sub(r"\s{2,}", " ", body).strip()
    notes = "\n".join(f"{_raised(i)} {_source(cited[e])}" for i, e in enumerate(order, 1) if e in cited)
    return body, notes, body + FOOTNOTES + notes if notes else body, len(order)


def formatted(answers: DataFrame) -> DataFrame:
    """answers (answer, links: array of ids, citations: array of structs, ...) with body, footnotes, formatted and n_citations."""
    ship(answers.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [format_answer(r["answer"] or "", r["links"] or [], r["citations"] or []) for r in b.select(["answer", "links", "citations"]).to_pylist()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int32()))] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "body", "footnotes", "formatted", "n_citations"])

    out = StructType(list(answers.schema.fields)).add("body", "string").add("footnotes", "string").add("formatted", "string").add("n_citations", "integer")
    return answers.mapInArrow(run, out)


# --- cleaning ----------------------------------------------------------------------------------


def tidy_lines(text: Column) -> Column:
    """White space collapsed within lines, blank lines gone."""
    lines = F.split(F.regexp_replace(T.text_of(text), r"\r\n?", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, T.normalize_whitespace), lambda x: x != ""), "\n")


def clean_summary(text: Column) -> Column:
    """A model's summary without an empty prefix."""
    tidy = tidy_lines(text)
    return tidy_lines(F.regexp_replace(tidy, rf"(?i)^(?:{'|'.join(EMPTY_PREFIXES)})[ :,\-]*", ""))


def without_instructions(text: Column) -> Column:
    """Evidence without the instructions that go with a table."""
    return T.strip(F.regexp_replace(T.text_of(text), r"(?s)<system_instruction>.*?</system_instruction>\s*", ""))


def compute_request(text: Column) -> Column:
    """The compute request in a model's text, as a struct of asset_id and sql; null if there is none that is whole."""
    from tessera.functions import structured

    inside = F.regexp_extract(T.text_of(text), r"(?s)<compute_request>(.*?)</compute_request>", 1)
    return structured.typed(inside, "asset_id string, sql string", ("asset_id", "sql"))


def parsed_contract(summary: Column) -> Column:
    """The three lines of a summary contract as a struct; null where one is missing."""
    line = lambda name: F.nullif(F.trim(F.regexp_extract(T.text_of(summary), rf"(?m)^{name}:[ \t]*(.*)$", 1)), F.lit(""))
    core, facts, hint = line("Semantic Core"), line("Fact Anchors"), line("Structural Hint")
    listed = lambda c: F.when(c == "none", F.array().cast("array<string>")).otherwise(F.transform(F.split(c, ","), lambda x: F.trim(x)))
    return F.when(core.isNotNull() & facts.isNotNull() & hint.isNotNull(), F.struct(core.alias("semantic_core"), listed(facts).alias("fact_anchors"), listed(hint).alias("structural_hints")))
