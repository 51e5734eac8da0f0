"""Knowledge graphs of answers: tolerant parsing, grounded nodes, validated edges, merging of graphs and labels."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import slug
from siltstone.operators.answer import synthesised
from siltstone.operators.fuzzy import similar_pairs

ANSWER_CAP = 5000
# Types of nodes.
TYPES = ("DRUG", "DISEASE", "GENE", "ANATOMY", "SYMPTOM", "OTHER")
# Labels and predicates that say nothing.
VAGUE_LABELS = [
    "protein", "proteins", "rna", "dna", "cell", "cells", "gene", "genes", "tissue", "tissues", "molecular", "cellular", "modification", "molecule", "molecules", "process", "pathway", "system", "physical", "chronic", "acute", "mechanical", "growth", "wasting",
]
VAGUE_PREDICATES = [
    "is managed by", "is controlled by", "is involved in", "involves", "relates to", "is related to", "is associated with", "is increased by", "is decreased by",
    "is affected by", "affects", "depends on", "is dependent on", "interacts with", "interaction with", "is", "has", "are",
]
RELATION = "struct<subject:string,predicate:string,object:string,citations:array<bigint>>"


def _complete_objects(raw: str) -> tuple[list[dict], bool]:
    """Objects of the relation list that are whole, and whether the text had to be cut."""
    start = raw.find("{")
    if start < 0:
        return [], False
    try:
        whole = json.loads(raw[start : raw.rfind("}") + 1])
        found = whole.get("relations")
        return [r for r in found if isinstance(r, dict)] if isinstance(found, list) else [], False
    except (json.JSONDecodeError, AttributeError):
        pass
    at = raw.find("[", raw.find('"relations"', start))
    if raw.find('"relations"', start) < 0 or at < 0:
        return [], False
    out, decoder, k = [], json.JSONDecoder(), at + 1
    while True:
        k = raw.find("{", k)
        if k < 0:
            break
        try:
            item, k = decoder.raw_decode(raw, k)
        except json.JSONDecodeError:
            k += 1
            continue
        if isinstance(item, dict) and "subject" in item:
            out.append(item)
    return out, bool(out)


def salvage(raw: Column) -> Column:
    """struct<relations, truncated> of a model's text: fenced, cut off or without JSON, it never fails."""

    @F.pandas_udf(f"struct<relations:array<{RELATION}>,truncated:boolean>")
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found, cut = _complete_objects(text or "")
            clean = [{"subject": str(r.get("subject") or ""), "predicate": str(r.get("predicate") or ""), "object": str(r.get("object") or ""), "citations": [c for c in r["citations"] if isinstance(c, int)] if isinstance(r.get("citations"), list) else []} for r in found]
            rows.append((clean, cut))
        return pd.DataFrame(rows, columns=["relations", "truncated"])

    return read(raw)


def node_types(raw: Column) -> Column:
    """map<label_lc, type> of a model's text: labels trimmed and lower-cased, types clamped to the known ones, else OTHER.

    The object of types may be absent or not an object, or the text cut off: then the map is empty.
    """
    given = F.from_json(F.get_json_object(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "$.types"), "map<string,string>")
    pairs = F.filter(F.map_entries(given), lambda e: e["value"].isNotNull())
    clean = F.transform(pairs, lambda e: F.struct(F.lower(F.btrim(e["key"])).alias("key"), F.upper(F.btrim(e["value"])).alias("value")))
    last = F.filter(clean, lambda e, i: ~F.exists(F.slice(clean, i + 2, F.size(clean)), lambda later: later["key"] == e["key"]))
    clamped = F.transform(last, lambda e: F.struct(e["key"].alias("key"), F.when(e["value"].isin(*TYPES), e["value"]).otherwise("OTHER").alias("value")))
    return F.coalesce(F.map_from_entries(clamped), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def prompt(answer: Column) -> Column:
    """struct<text, truncated>: the part of an answer that an extraction is asked about."""
    return F.struct(F.left(answer, F.lit(ANSWER_CAP)).alias("text"), (F.length(answer) > ANSWER_CAP).alias("truncated"))


def has_duplicates(labels: DataFrame, graph: str, label: str, words: Column, least: float = 0.7) -> DataFrame:
    """(graph, hint): whether any two labels of a graph are as similar as ``least``; asked before labels are grouped."""
    keyed = labels.select(graph, F.concat_ws("|", F.col(graph).cast("string"), F.col(label)).alias("k"), F.transform(words, lambda w: F.concat_ws("|", F.col(graph).cast("string"), w)).alias("w"))
    hit = similar_pairs(keyed, "k", F.col("w"), least).select(F.substring_index("a", "|", 1).alias("_g")).distinct()
    every = labels.select(graph, F.col(graph).cast("string").alias("_g")).distinct()
    return every.join(hit.withColumn("hint", F.lit(True)), "_g", "left").select(graph, F.coalesce("hint", F.lit(False)).alias("hint"))


def grouped(labels: DataFrame, graph: str, label: str, spec: str, providers: dict) -> DataFrame:
    """(graph, groups): the raw answer of the provider that a graph's spec names to its labels; fewer than two give none."""
    listed = labels.groupBy(graph).agg(F.array_join(F.sort_array(F.collect_set(label)), "\n").alias("labels"), F.count_distinct(label).alias("n"), F.first(spec).alias("_spec"))
    return synthesised(listed.where("n >= 2"), F.col("_spec"), "labels", providers, "groups").select(graph, "groups")


#: What an exported payload holds.
PAYLOAD = "struct<nodes:array<struct<id:string,label:string,type:string>>,edges:array<struct<source:string,predicate:string,target:string,citations:array<bigint>>>>"


def exported(found: DataFrame, labelled: DataFrame, graph: str) -> DataFrame:
    """(graph, payload, edges): the session's nodes and edges as one JSON text, in order of their ids, and the edges it was made of."""
    listed = lambda df, cols: df.groupBy(graph).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("x"))
    n = listed(labelled, ["id", "label", "type"]).withColumnRenamed("x", "nodes")
    e = listed(found, ["source", "predicate", "target", "citations"]).withColumnRenamed("x", "edges")
    return n.join(e, graph, "left").select(graph, F.to_json(F.struct("nodes", "edges")).alias("payload"), "edges")


def payload(text: Column) -> Column:
    """The nodes and edges of an exported text; null for one that cannot be read."""
    return F.from_json(text, PAYLOAD)


def restored(payloads: DataFrame, graph: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of exported payloads; a text that cannot be read gives none."""
    read = payloads.select(graph, payload(F.col("payload")).alias("p"))
    return read.select(graph, F.explode("p.edges").alias("e")).select(graph, "e.*"), read.select(graph, F.explode("p.nodes").alias("n")).select(graph, "n.*")


def whole(sent: DataFrame, graph: str) -> DataFrame:
    """(graph) of ``exported`` rows whose edges are all in the payload again; text and edges are compared where they lie."""
    read = sent.where("edges is not null").select(graph, "edges", payload(F.col("payload"))["edges"].alias("back"))
    return read.where((F.col("edges") == F.col("back")) | (F.size(F.array_except("edges", "back")) == 0)).select(graph)


def _firsts(of: str, key: str) -> Column:
    """Of the structures in the sorted list ``of`` the first of each ``key``, by which they are sorted."""
    return F.filter(of, lambda x, i: (i == 0) | (F.get(F.col(of), i - 1)[key] != x[key]))


def nodes(relations: DataFrame, answers: DataFrame, graph: str, order: str, types: DataFrame | None = None) -> DataFrame:
    """(graph, id, label, label_lc, type): ends of relations that the answer's text contains, first spelling wins.

    ``relations`` is (graph, order, subject, predicate, object), ``answers`` (graph, answer), ``types`` (graph, label_lc, type).
    """
    # A graph is what one answer gave: its ends are one sorted list.  All that is asked of it needs rows dealt by the
    # graph alone, which large tables should be by their rows before.
    end = lambda side, c: F.struct(F.lower(F.btrim(c)).alias("label_lc"), F.struct(order, F.lit(side).alias("side")).alias("at"), F.btrim(c).alias("label"))
    both = F.flatten(F.collect_list(F.array(end(0, "subject"), end(1, "object"))))
    ends = relations.groupBy(graph).agg(F.sort_array(F.filter(both, lambda x: x["label"] != "")).alias("ends"))
    grounded = ends.select(graph, _firsts("ends", "label_lc").alias("ends")).join(answers.select(graph, F.lower("answer").alias("answer")), graph)
    if types is not None:
        grounded = grounded.join(_by_graph(types, graph, "label_lc", "type", "types"), graph, "left")
    kind = lambda x: F.coalesce(F.try_element_at(F.col("types"), x["label_lc"]), F.lit("OTHER")) if types is not None else F.lit("OTHER")
    said = F.filter("ends", lambda x: F.contains(F.col("answer"), x["label_lc"]) & ~x["label_lc"].isin(VAGUE_LABELS))
    named = F.transform(said, lambda x: F.struct(slug(x["label"]).alias("id"), x["at"].alias("at"), x["label_lc"].alias("label_lc"), x["label"].alias("label"), kind(x).alias("type")))
    by_id = grounded.select(graph, F.sort_array(named).alias("named"))
    lead = F.transform(_firsts("named", "id"), lambda x: F.struct(x["id"], F.struct(x["label"].alias("label"), x["type"].alias("type"))))
    rows = by_id.select(graph, "named", F.map_from_entries(lead).alias("lead")).select(graph, "lead", F.explode("named").alias("x"))
    rows = rows.select(graph, "x.id", "x.label_lc", F.col("lead")[F.col("x.id")].alias("l"))
    return rows.select(graph, "id", "l.label", "label_lc", "l.type")


def _by_graph(rows: DataFrame, graph: str, key: str, value: str, name: str) -> DataFrame:
    """(graph, name): a map of each graph's keys to their least value; a graph is what one answer gave, so the map is small."""
    listed = rows.where(F.col(value).isNotNull()).groupBy(graph).agg(F.sort_array(F.collect_list(F.struct(key, value))).alias("_all"))
    return listed.select(graph, F.map_from_entries(_firsts("_all", key)).alias(name))


def edges(relations: DataFrame, labelled: DataFrame, graph: str, order: str) -> DataFrame:
    """(graph, source, predicate, target, citations): both ends known and different, no vague predicate, three words at most.

    ``relations`` has citations as array<long>; citations of equal edges unite in the order first seen.
    """
    pred = F.lower(F.btrim("predicate"))
    rows = relations.select(graph, order, F.lower(F.btrim("subject")).alias("source_lc"), F.lower(F.btrim("object")).alias("target_lc"), pred.alias("pred"), "citations")
    rows = rows.where((F.col("pred") != "") & ~F.col("pred").isin(VAGUE_PREDICATES)).join(_by_graph(labelled, graph, "label_lc", "id", "ids"), graph)
    rows = rows.select(graph, order, F.try_element_at("ids", F.col("source_lc")).alias("source"), F.try_element_at("ids", F.col("target_lc")).alias("target"), "pred", "citations").where("source <> target")
    short = F.array_join(F.slice(F.split("pred", r"\s+"), 1, 3), " ")
    listed = F.sort_array(F.collect_list(F.struct(order, "citations")))
    united = F.array_distinct(F.flatten(F.transform(listed, lambda x: F.coalesce(x["citations"], F.array().cast("array<bigint>")))))
    return rows.withColumn("predicate", short).groupBy(graph, "source", "predicate", "target").agg(united.alias("citations"))


def evidence(citations: Column, by_index: Column) -> Column:
    """The chunk ids that citations stand for, each once, in order: an index of ``by_index`` (map index -> id), else an id itself.

    An index comes first where a number could be both; what is neither is dropped, and a null list is empty.
    """
    ids = F.map_values(by_index)
    named = F.transform(citations, lambda x: F.coalesce(F.try_element_at(by_index, x), F.when(F.array_contains(ids, x), x)))
    return F.coalesce(F.array_distinct(F.array_compact(named)), F.array().cast("array<bigint>"))


def connected(labelled: DataFrame, found: DataFrame, graph: str) -> DataFrame:
    """(graph, id, label, type, citations): nodes that an edge touches, with the citations of their edges."""
    touch = found.select(graph, F.explode(F.array("source", "target")).alias("id"), "citations")
    cited = touch.groupBy(graph, "id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("citations")))).alias("citations"))
    return labelled.select(graph, "id", "label", "type").distinct().join(cited, [graph, "id"])


def diagnosis(answer: Column, n_edges: Column) -> Column:
    """Why a graph is empty: the answer was cut, or nothing was found; null if it has edges."""
    return F.when(n_edges > 0, None).when(F.length(answer) > ANSWER_CAP, "truncated input").otherwise("no relations")


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, label, type, citations): citations unite, a known type beats OTHER, the longer label wins."""
    every = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    label = F.max_by("label", F.struct(F.length("label").alias("n"), (-F.col("age")).alias("a")))
    kind = F.coalesce(F.min_by(F.when(F.col("type") != "OTHER", F.col("type")), F.when(F.col("type") != "OTHER", F.col("age"))), F.lit("OTHER"))
    return every.groupBy("id").agg(label.alias("label"), kind.alias("type"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("citations")))).alias("citations"))


def merge_edges(old: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
    """(source, predicate, target, citations): equal edges unite their citations; edges with an unknown end (id) are dropped."""
    every = old.select("source", "predicate", "target", "citations").unionByName(new.select("source", "predicate", "target", "citations"))
    for end in ("source", "target"):
        every = every.join(known.select(F.col("id").alias(end)), end, "left_semi")
    return every.groupBy("source", "predicate", "target").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("citations")))).alias("citations"))


def valid_groups(groups: DataFrame, labels: DataFrame, group: str, order: str, member: str, canonical: str) -> DataFrame:
    """(group, canonical, members): members restricted to given labels without regard to case, two or more.

    The proposed canonical stays if it survives, else the first member takes its place.
    """
    known = labels.groupBy(F.lower("label").alias("key")).agg(F.max("label").alias("label"))
    rows = groups.withColumn("key", F.lower(F.btrim(member))).join(known, "key")
    rows = rows.groupBy(group, "label").agg(F.min(order).alias("at"), F.max(F.lower(F.btrim(canonical))).alias("wanted"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("at", "label"))), lambda x: x["label"])
    found = rows.groupBy(group).agg(listed.alias("members"), F.max("wanted").alias("wanted")).where(F.size("members") >= 2)
    chosen = F.filter("members", lambda m: F.lower(m) == F.col("wanted"))
    return found.select(group, F.coalesce(F.try_element_at(chosen, F.lit(1)), F.col("members")[0]).alias("canonical"), "members")


def redirect(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges (source, predicate, target, citations) with merged ends (label, canonical); loops go, equal edges unite."""
    to = lambda c: mapping.select(F.col("label").alias(c), F.col("canonical").alias(f"{c}_to"))
    moved = found.join(to("source"), "source", "left").join(to("target"), "target", "left")
    moved = moved.select(F.coalesce("source_to", "source").alias("source"), "predicate", F.coalesce("target_to", "target").alias("target"), "citations").where("source <> target")
    return moved.groupBy("source", "predicate", "target").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("citations")))).alias("citations"))


def induced(found: DataFrame, labelled: DataFrame, needle: str) -> DataFrame:
    """Edges with both ends among the nodes whose label contains ``needle``."""
    hits = labelled.where(F.contains(F.lower("label"), F.lit(needle.lower()))).select("id").distinct()
    return found.join(hits.withColumnRenamed("id", "source"), "source", "left_semi").join(hits.withColumnRenamed("id", "target"), "target", "left_semi")


def without_node(found: DataFrame, node: str) -> DataFrame:
    return found.where((F.col("source") != node) & (F.col("target") != node))
