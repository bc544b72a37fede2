"""The subject areas of every document by label propagation over a similarity graph (problem 9).

The graph is kept factored: documents that share a term are linked through it, so no pair of documents is ever listed.
Its edges are verified by language: a term of more than ``COMMON`` of a language's distinct texts links only documents that
have no other linking term, and one of fewer than ``RARE`` documents links nothing. Raters' labels are clamped seeds. Labels
run from the documents to the terms and back by DataFrame joins; a term passes on what it is concentrated in, weighed by the
concentration, and an occurrence counts for the area that its document and its term agree on, so a document keeps several
areas and a term keeps its own one in documents of several. A seed that its own terms contradict loses its clamp. A document
is about the areas that hold ``SHARE`` of its evidence.

Defined results: null, empty and wordless texts have no row; repeated labels count once; labels of unknown documents or areas
count for nothing; a document with words but no linking term has no row; without any label there is no row.
"""

from __future__ import annotations

import re
from collections import Counter

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from cuelight.functions.batches import map_columns, spread
from cuelight.llm.lookalikes import fold_all
from cuelight.llm.sentences import script
from cuelight.session import cut

#: A term of a larger share of a language's distinct texts is no subject word beside others; neither is one of fewer documents than RARE.
COMMON, RARE = 0.2, 3
#: Documents that a language must have for its own share of a term to be told.
LANGUAGE = 20
#: Rounds of propagation.
ROUNDS = 2
#: Labels that a term has of no area beforehand, and evidence that a document has of each.
PRIOR, GROUND = 3.0, 0.05
#: Least share of a document's evidence, and least evidence, of an area that it is about; its first area needs no share.
SHARE, EVIDENCE = 0.22, 0.7
#: Least share of evidence of a label that is trusted, once there is more than CLEAR.
TRUSTED, CLEAR = 0.06, 2.0
#: Times that one term counts in a document.
TIMES = 2
#: Rows of the terms' table up to which it is broadcast (under 200 bytes each); larger ones are joined by shuffle.
BROADCAST_ROWS = 400_000

#: Words of the languages that share the Latin script.
FUNCTION_WORDS = {
    "en": "the and of to is was it that with for from on has been this you".split(),
    "fr": "le la les des est une dans pour pas que il qui sur au encore".split(),
    "de": "der die das und ist nicht wir den mir von noch auf wo war ein".split(),
    "es": "el los las que en una por con para del todo no se fue de".split(),
}
_by_word = {w: [n for n, ws in FUNCTION_WORDS.items() if w in ws] for ws in FUNCTION_WORDS.values() for w in ws}
_words = re.compile("[a-zß-öø-ɏḀ-ỿ]+(?:'[a-z]+)?|[ァ-ヺー]{2,}|[一-鿿々]+|[가-힣]+|[ऀ-ॿ]+|[฀-๿]+")
_next = re.compile("[ぁ-ゖ]{2}")


#: Hashes that a worker remembers; results do not depend on it.
HASHES = 500_000
_hashes: dict[str, int] = {}


def terms(text: str) -> tuple[str, Counter]:
    """The language group of a folded text in lower case and its terms: words and pairs of words, pairs of characters in
    runs of kanji, four characters of Thai, Korean words without their last syllable."""
    out: list[str] = []
    votes: Counter = Counter()
    before = ""
    for m in _words.finditer(text):
        w = m.group()
        c, here = w[0], ""
        if "一" <= c <= "鿿" or c == "々":
            if len(w) == 1:
                after = _next.match(text, m.end())
                if after:
                    out.append(w + after.group())
            out += [w[i : i + 2] for i in range(len(w) - 1)]
        elif "가" <= c <= "힣":
            if len(w) > 1:
                out.append(w[: max(2, len(w) - 1)])
        elif "฀" <= c <= "๿":
            out += [w[i : i + 4] for i in range(len(w) - 3)]
        elif c < "ɐ" or "Ḁ" <= c <= "ỿ":
            for n in _by_word.get(w, ()):
                votes[n] += 1
            if len(w) > 2:
                out.append(w)
                if before:
                    out.append(f"{before} {w}")
            here = w if len(w) > 1 else ""
        elif len(w) > 1:
            out.append(w)
        before = here
    s = script(text)
    return (s if s != "la" else max(sorted(votes), key=votes.get) if votes else "la"), Counter(out)


def edges(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc``, ``lang``, ``terms``, ``times``): the terms of every document, as 64-bit hashes."""
    rows = documents.select(documents[id_col].alias("doc"), documents[text_col].alias("text")).where("doc is not null and text rlike '\\\\w|[^\\\\x00-\\\\x7f]'")
    schema = StructType([rows.schema["doc"], StructField("lang", StringType()), StructField("terms", ArrayType(LongType())), StructField("times", ArrayType(IntegerType()))])

    def batch(docs: list, texts: list) -> dict:
        known = _hashes

        def remember(term: str) -> int:
            if len(known) >= HASHES:
                known.clear()
            known[term] = xxhash.xxh3_64_intdigest(term) - (1 << 63)
            return known[term]

        out: dict = {"doc": docs, "lang": [], "terms": [], "times": []}
        for text in fold_all(texts):
            lang, found = terms(text.lower())
            out["lang"].append(lang)
            out["terms"].append([known.get(t) or remember(t) for t in found])
            out["times"].append([min(n, TIMES) for n in found.values()])
        return out

    return map_columns(spread(rows, "doc"), batch, schema)


def _join_terms(rows: DataFrame, side: DataFrame, count: int) -> DataFrame:
    """Joined by term: the terms' table is broadcast if its counted rows allow it, else both sides are shuffled."""
    return rows.join(F.broadcast(side) if count <= BROADCAST_ROWS else side, "term")


def propagate(graph: DataFrame, seeds: DataFrame, areas: list[str]) -> DataFrame:
    """(doc, e0 ... en): the evidence of every document for each of the areas.

    ``graph`` has doc, lang, terms, times; ``seeds`` has doc, area. ``areas`` is the small dimension of areas.
    """
    k = range(len(areas))
    flat = graph.select("doc", "lang", F.explode(F.arrays_zip("terms", "times")).alias("x")).select("doc", "lang", F.col("x.terms").alias("term"), F.col("x.times").alias("n"))
    # shares are of distinct texts, so copies of one text make none of its terms common; RARE counts documents
    texts = graph.where("size(terms) > 0").withColumn("text", F.xxhash64("lang", "terms", "times"))
    firsts = texts.groupBy("lang", "text").agg(F.min("doc").alias("doc"))
    many = F.broadcast(firsts.groupBy("lang").agg(F.count("*").alias("docs")))
    first = flat.join(firsts.select("doc", F.lit(1).alias("first")), "doc", "left")
    links = first.groupBy("term", "lang").agg(F.count("*").alias("df"), F.count("first").alias("own")).join(many, "lang")
    links = links.groupBy("term").agg(F.sum("df").alias("df"), F.max(F.when(F.col("docs") >= LANGUAGE, F.col("own") / F.col("docs")).otherwise(0.0)).alias("share"))
    links = cut(links.where(F.col("df") >= RARE).select("term", (F.col("share") > COMMON).alias("common")))
    linked = _join_terms(flat.select("doc", "term", "n"), links, links.count())
    # common terms link only the documents that no other term links; what they say is weighed by their concentration
    lone = linked.groupBy("doc").agg(F.min("common").alias("lone")).where("lone").select("doc")
    flat = cut(linked.where("not common").unionByName(linked.where("common").join(lone, "doc")))

    labels = seeds.where(F.col("area").isin(areas)).select("doc", "area").distinct()
    marks = [F.max((F.col("area") == a).cast("double")).alias(f"m{i}") for i, a in enumerate(areas)]
    labels = cut(labels.groupBy("doc").agg(*marks).join(graph.select("doc").distinct(), "doc"))

    def added(columns: list[Column]) -> Column:
        total = columns[0]
        for c in columns[1:]:
            total = total + c
        return total

    given = added([F.col(f"m{i}") for i in k])
    counted = linked.join(F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels, "doc")
    counted = counted.groupBy("term", "common").agg(*(F.sum(F.col("n") * F.col(f"m{i}") / given).alias(f"c{i}") for i in k))
    evidence = None
    for step in range(ROUNDS):
        # what each term is concentrated in, freed of the areas' sizes
        counted = cut(counted)
        sizes = counted.where("not common").agg(*(F.coalesce(F.sum(f"c{i}"), F.lit(0.0)).alias(f"c{i}") for i in k)).first()
        size = sum(sizes) or 1.0
        held = added([F.col(f"c{i}") for i in k])
        lifted = counted.select("term", *(((F.col(f"c{i}") + PRIOR / len(areas)) / (held + PRIOR) / (sizes[i] / size + 0.02)).alias(f"l{i}") for i in k))
        lifts = added([F.col(f"l{i}") for i in k])
        said = lifted.select("term", *((F.col(f"l{i}") / lifts).alias(f"q{i}") for i in k))
        pure = added([F.col(f"q{i}") * F.log(F.col(f"q{i}") * len(areas)) for i in k]) / F.log(F.lit(max(2.0, len(areas))))
        said = cut(said.withColumn("w", pure))
        voices = said.count()
        spoken = _join_terms(flat, said, voices).withColumn("v", F.col("n") * F.col("w"))
        first = spoken.groupBy("doc").agg(*(F.sum(F.col("v") * F.col(f"q{i}")).alias(f"a{i}") for i in k))
        # the clamp: a seed has its labels only, unless its own terms contradict them
        all_a = added([F.col(f"a{i}") for i in k])
        first = first.join(labels, "doc", "left")
        kept = [F.when((all_a > CLEAR) & (F.col(f"a{i}") < TRUSTED * all_a), 0.0).otherwise(F.col(f"m{i}")) for i in k]
        first = first.select("doc", *(F.col(f"a{i}") for i in k), *(x.alias(f"m{i}") for i, x in zip(k, kept)))
        free = F.coalesce(given, F.lit(0.0)) == 0
        first = first.select("doc", *(((F.col(f"a{i}") + GROUND) * F.when(free, 1.0).otherwise(F.col(f"m{i}"))).alias(f"t{i}") for i in k))
        mine = cut(first)
        # an occurrence counts for what its document and its term agree on
        both = _join_terms(flat, said, voices).join(mine, "doc")
        agreed = added([F.col(f"t{i}") * F.col(f"q{i}") for i in k])
        parts = [F.col("n") * F.col("w") * F.col(f"t{i}") * F.col(f"q{i}") / agreed for i in k]
        if step < ROUNDS - 1:
            counted = both.groupBy("term", "common").agg(*(F.sum(p).alias(f"c{i}") for i, p in enumerate(parts)))
        else:
            evidence = both.groupBy("doc").agg(*(F.sum(p).alias(f"e{i}") for i, p in enumerate(parts)))
    return evidence


def subjects(documents: DataFrame, labels: DataFrame, subject_areas: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``area``): the areas that each document is about. ``subject_areas`` is a small dimension."""
    areas = sorted({r.area for r in subject_areas.select("area").where("area is not null").collect()})
    if not areas:
        return documents.select(id_col, F.lit("").alias("area")).limit(0)
    graph = cut(edges(documents, id_col, text_col))
    e = propagate(graph, labels.select(labels[id_col].alias("doc"), labels["area"]), areas)
    pairs = F.array(*(F.struct(F.lit(a).alias("area"), F.col(f"e{i}").alias("e")) for i, a in enumerate(areas)))
    e = e.select("doc", pairs.alias("p")).withColumn("all", F.expr("aggregate(p, 0D, (s, x) -> s + x.e)")).withColumn("top", F.expr("array_max(transform(p, x -> x.e))"))
    e = e.where("all > 0").select("doc", "all", "top", F.explode("p").alias("x"))
    return e.where((F.col("x.e") == F.col("top")) | ((F.col("x.e") >= EVIDENCE) & (F.col("x.e") >= SHARE * F.col("all")))).select(F.col("doc").alias(id_col), "x.area")
