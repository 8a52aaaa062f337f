"""Queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import canonical, encode, lookalike, packing, scans, spans, splitting
from tessera.session import table


def paper_texts(spark: SparkSession, d: str, markdown: bool = False) -> DataFrame:
    """(paper_id, field, text): a row per section of each paper, and its markdown if asked for."""
    papers = table(spark, d, "parsed_papers")
    fields = F.coalesce(F.map_entries("sections"), F.array().cast("array<struct<key:string,value:string>>"))
    if markdown:
        fields = F.concat(fields, F.array(F.struct(F.lit("markdown").alias("key"), F.col("markdown").alias("value"))))
    return papers.select("paper_id", F.explode(fields).alias("f")).select("paper_id", F.col("f.key").alias("field"), F.col("f.value").alias("text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = scans.noise(table(spark, d, "parsed_papers"))
    return found.select(F.col("id").alias("paper_id"), "section", "noise").distinct()


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair(table(spark, d, "parsed_papers"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split(paper_texts(spark, d, markdown=True), ["paper_id", "field"], "text", with_text=False)
    return pieces.where("piece_no = 0").select("paper_id", "field")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(paper_texts(spark, d, markdown=True), ["paper_id", "field"], "text")


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """(src_field, row_id, pos, value) of the freely typed values."""
    states, terms = table(spark, d, "cell_states"), table(spark, d, "cl_subset")
    many = lambda df, src, col: df.select(F.lit(src).alias("src_field"), "row_id", F.posexplode(col).alias("pos", "value")).withColumn("pos", F.col("pos").cast("bigint"))
    names = terms.select(F.lit("cl_subset.name").alias("src_field"), "row_id", F.lit(0).cast("bigint").alias("pos"), F.col("name").alias("value"))
    return many(states, "cell_states.aliases", "aliases").unionByName(many(terms, "cl_subset.synonyms", "synonyms")).unionByName(names)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    reference = table(spark, d, "cell_type_list")
    exact = reference.select(F.col("canon_name").alias("value")).unionByName(reference.select(F.col("short_name").alias("value")))
    return canonical.match(_typed(spark, d).join(exact, "value", "left_anti"), reference).select("src_field", "row_id", "pos", "canon_id")


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    mapped = canonical.match(_typed(spark, d), table(spark, d, "cell_type_list"))
    return mapped.where("canon_id = 0").groupBy("src_field", "value").agg(F.count("*").alias("n_rows"))


def p5_similar(spark: SparkSession, d: str) -> DataFrame:
    """The similarity join by itself: plain words of the typed values against those of the list."""
    plain = lambda df: df.select(F.explode(F.regexp_extract_all(F.lower("value"), F.lit("([a-z]+)"), F.lit(1))).alias("w")).distinct()
    listed = table(spark, d, "cell_type_list").select(F.col("canon_name").alias("value"))
    met = canonical.candidates(plain(_typed(spark, d).where("value is not null")).withColumnRenamed("w", "form"), plain(listed).withColumnRenamed("w", "stem"), 0.4)
    return met.select("form", "stem", F.round("jaccard", 6).alias("jaccard"))


def _titles_and_texts(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "parsed_papers").select("paper_id", F.lit("title").alias("field"), F.col("title").alias("text"))
    return titles.unionByName(paper_texts(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = lookalike.same_look(_titles_and_texts(spark, d), "paper_id", "field", "text")
    return pairs.select(F.col("id_a").alias("paper_id_a"), F.col("id_b").alias("paper_id_b"), "field")


def p6_unified(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.unify(_titles_and_texts(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.pack(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared(table(spark, d, "documents")).pairs().select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared(table(spark, d, "documents")).spans().select(F.col("key").alias("doc_id"), "start", "end")


def p9_share(spark: SparkSession, d: str) -> DataFrame:
    return spans.share(table(spark, d, "documents"))


def p9_repeated(spark: SparkSession, d: str) -> DataFrame:
    return spans.repeated_units(table(spark, d, "documents"))


def p3_checked(spark: SparkSession, d: str) -> DataFrame:
    """What p3_pieces must keep, per text: limit, overlap, and the text given back by its pieces."""
    pieces = p3_pieces(spark, d)
    one = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "piece"))), c)
    parts = pieces.groupBy("paper_id", "field").agg(one(lambda p: p).alias("p"))
    fresh = F.transform("p", lambda p, i: F.when(i == 0, p["piece"]).otherwise(F.substring(p["piece"], F.lit(151), F.length(p["piece"]))))
    n = F.size("p")
    overlap = F.forall(F.sequence(F.lit(1), n - 1), lambda i: F.get("p", i)["start"] == F.get("p", i - 1)["end"] - 150)
    return parts.select(
        "paper_id", "field", F.get("p", n - 1)["end"].alias("n_chars"), F.md5(F.array_join(fresh, "")).alias("digest"), ((n > 1) & overlap).alias("overlap_ok"),
        F.forall("p", lambda p: (F.length(p["piece"]) <= 2000) & (F.length(p["piece"]) == p["end"] - p["start"])).alias("limit_ok"),
    )


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the ids of p7_ids spell, and whether any id is none of the vocabulary's."""
    return encode.decode(encode.encode(table(spark, d, "documents"))).select("doc_id", "text", F.forall("ids", lambda i: (i >= 0) & (i < 50_256)).alias("known"))


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """What p8_containers must keep: every document's tokens placed once and in order, no container
    over its capacity, nothing laid on top of another, none cut but what exceeds a container."""
    docs = table(spark, d, "documents")
    placed = packing.pack(docs)
    size = encode.encode(docs).select("doc_id", F.size("ids").alias("n"))
    per = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("pieces"), F.sum("piece").alias("nos"), F.min("token_start").alias("first"), F.max(F.col("token_start") + F.col("n_tokens")).alias("last"))
    good = (F.col("placed") == F.col("n")) & (F.col("first") == 0) & (F.col("last") == F.col("n")) & (F.col("nos") == F.col("pieces") * (F.col("pieces") - 1) / 2) & ((F.col("pieces") == 1) | (F.col("n") > 2048))
    full = placed.where("n_tokens > 0").groupBy("container").agg(F.sum("n_tokens").alias("n"), F.max(F.col("at") + F.col("n_tokens")).alias("end"), F.min("at").alias("at"))
    boxes = full.agg(F.coalesce(F.sum(((F.col("n") > 2048) | (F.col("n") != F.col("end")) | (F.col("at") != 0)).cast("bigint")), F.lit(0)).alias("n_bad_containers"))
    return size.join(per, "doc_id", "left").agg(F.count("*").alias("n_docs"), F.sum((~F.coalesce(good, F.lit(False))).cast("bigint")).alias("n_bad_docs")).crossJoin(boxes)


def p9_linked(spark: SparkSession, d: str) -> DataFrame:
    """Per document of 200 characters or more the class of its copies, and the links of its class."""
    return spans.shared(table(spark, d, "documents")).linked().withColumnRenamed("key", "doc_id")


QUERIES = {
    "p2_found": p2_found, "p2_repaired": p2_repaired, "p3_found": p3_found, "p3_pieces": p3_pieces, "p5_found": p5_found, "p5_unmatched": p5_unmatched, "p5_similar": p5_similar,
    "p6_found": p6_found, "p6_unified": p6_unified, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_fill": p8_fill,
    "p9_found": p9_found, "p9_spans": p9_spans, "p9_share": p9_share, "p9_repeated": p9_repeated,
    "p3_checked": p3_checked, "p7_decoded": p7_decoded, "p8_checked": p8_checked, "p9_linked": p9_linked,
}

_TEXTS = """select paper_id, unnest(map_keys(sections)) as field, unnest(map_values(sections)) as text from parsed_papers
 union all select paper_id, 'markdown', markdown from parsed_papers"""

_TYPED = """select unnest(aliases) as value from cell_states union all select unnest(synonyms) from cl_subset union all select name from cl_subset"""
_PAIRS = "list_distinct([substr('^' || w || '$', i, 2) for i in range(1, length(w) + 2)])"

SQL = {
    "p5_similar": f"""with f as (select w as form, {_PAIRS} as t from (select distinct unnest(regexp_extract_all(lower(value), '[a-z]+')) as w from ({_TYPED}) where value is not null)),
 s as (select w as stem, {_PAIRS} as t from (select distinct unnest(regexp_extract_all(lower(canon_name), '[a-z]+')) as w from cell_type_list)),
 j as (select form, stem, len(list_intersect(f.t, s.t))::double as b, len(f.t) + len(s.t) as n from f, s)
 select form, stem, round(b / (n - b), 6) as jaccard from j where b / (n - b) >= 0.4""",
    "p3_found": f"select paper_id, field from ({_TEXTS}) where length(text) > 2000",
    "p3_checked": f"select paper_id, field, length(text) as n_chars, md5(text) as digest, true as overlap_ok, true as limit_ok from ({_TEXTS}) where length(text) > 2000",
    "p7_decoded": "select doc_id, coalesce(text, '') as text, true as known from documents",
    "p8_checked": "select count(*) as n_docs, 0::bigint as n_bad_docs, 0::bigint as n_bad_containers from documents",
}

# Every stretch of 200 characters by its digest: exact, and quick enough at a thousand documents.
_GRAMS = """g as (select doc_id, i, md5(substr(text, i::bigint, 200)) as h from (select doc_id, text, unnest(range(1, length(text) - 198)) as i from documents where length(text) >= 200))"""
_SPANS = f"""with {_GRAMS}, hh as (select h from g group by h having count(distinct doc_id) > 1),
 c as (select doc_id, i from g semi join hh using (h)),
 e as (select doc_id, i, case when i - 200 > lag(i) over (partition by doc_id order by i) then 1 else 0 end as cut from c),
 r as (select doc_id, i, sum(cut) over (partition by doc_id order by i) as run from e),
 s as (select doc_id, min(i) - 1 as start, max(i) + 199 as end from r group by doc_id, run)"""
SQL |= {
    "p9_found": f"with {_GRAMS}, u as (select distinct doc_id, h from g) select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from u a join u b using (h) where a.doc_id < b.doc_id",
    "p9_spans": f'{_SPANS} select doc_id, start, "end" from s',
    "p9_share": f"""{_SPANS}, p as (select doc_id, count(*) as n_spans, sum("end" - start)::bigint as n_shared from s group by 1)
 select doc_id, coalesce(length(text), 0)::bigint as n_chars, coalesce(n_spans, 0)::bigint as n_spans, coalesce(n_shared, 0)::bigint as n_shared, case when length(text) > 0 then round(coalesce(n_shared, 0) / length(text), 4) else 0.0 end::double as share from documents left join p using (doc_id)""",
    "p9_linked": f"""with {_GRAMS}, t as (select doc_id, md5(text) as m from documents where length(text) >= 200), k as (select m, min(doc_id) as rep, count(*) as copies from t group by 1), f as (select doc_id, rep, copies from t join k using (m)),
 u as (select distinct rep, h from g join f using (doc_id)), l as (select rep, count(distinct other) as n from (select a.rep, b.rep as other from u a join u b using (h) where a.rep <> b.rep) group by 1)
 select doc_id, rep, copies, coalesce(n, 0)::bigint as n_linked from f left join l using (rep)""",
    "p9_repeated": r"""with l as (select doc_id, unnest(string_split(text, E'\n')) as line, generate_subscripts(string_split(text, E'\n'), 1) as no from documents where length(text) >= 200),
 p as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by no rows between unbounded preceding and 1 preceding), 0) as start, array_to_string(list_filter(regexp_split_to_array(line, '[\s\x0b\x1c-\x1f\x85\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> ''), ' ') as u from l),
 q as (select doc_id, start::bigint as start, (start + length(line))::bigint as "end", u, first_value(doc_id) over w as kd, first_value(start) over w as ks, count(*) over (partition by u) as n from p where length(line) >= 200 and length(u) >= 200 window w as (partition by u order by doc_id, start))
 select doc_id, start, "end", kd as kept_doc_id, ks::bigint as kept_start from q where n > 1 and (doc_id, start) <> (kd, ks)""",
}


def _one_form_sql(text: str) -> str:
    """The one form in SQL: composed, then a character by a character, then those that become several."""
    single = {a: b for a, b in lookalike.rules() if len(a) == 1} | {"\t": " "}
    for c in lookalike._composed():  # a twin's composed letters
        apart = unicodedata.normalize("NFD", c)
        if (one := unicodedata.normalize("NFC", single.get(apart[0], apart[0]) + apart[1:])) != c and len(apart) > 1:
            single[c] = one
    single |= {"\u212a": "K", "\u212b": "\u00c5", "\u2126": "\u03a9"}
    one_to_one = {a: b for a, b in single.items() if len(b) == 1}
    gone = "".join(a for a, b in single.items() if not b)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"translate(nfc_normalize({text}), {quoted(''.join(one_to_one) + gone)}, {quoted(''.join(one_to_one.values()))})"
    for a, b in single.items():
        if len(b) > 1:
            out = f"replace({out}, {quoted(a)}, {quoted(b)})"
    return f"nfc_normalize({out})"


_LOOKS = "select paper_id, 'title' as field, title as text from parsed_papers union all select paper_id, unnest(map_keys(sections)), unnest(map_values(sections)) from parsed_papers"
SQL |= {
    "p6_unified": f"select paper_id, field, {_one_form_sql('text')} as text from ({_LOOKS})",
    "p6_found": f"""with o as (select paper_id, field, text, {_one_form_sql('text')} as one from ({_LOOKS})), k as (select * from o where regexp_matches(one, '\\S'))
 select distinct a.paper_id as paper_id_a, b.paper_id as paper_id_b, a.field from k a join k b on a.field = b.field and a.one = b.one where a.text <> b.text and a.paper_id < b.paper_id""",
}
