"""Registered queries of the corpus operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlake.llm import ann, chat_format, crc_resampling, manifest, merkle, mixing, ngram_join, packing, quality
from hazardlake.llm import secret_scan, simhash, toxicity, warc
from hazardlake.session import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    """The word-level vocabulary file of the installed package, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every token piece of every document."""
    cut = packing.pieces(_table(spark, sf_dir, "documents"), word_vocabulary())
    return packing.pack(materialize(cut, "pieces"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every document and its edited text."""
    return merkle.compare_with_next(_table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every row whose vec_id is divisible by 20."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return ngram_join.near_components(_table(spark, sf_dir, "documents"))


def rank_vocabulary() -> dict[str, str]:
    """The byte-pair ranks of the installed package and their splitting rule."""
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    found = secret_scan.scan(_table(spark, sf_dir, "documents"), **rank_vocabulary())
    listed = F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.start, s.end))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(listed, ",").alias("spans"))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its archive holds it."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a document that the mixture draws, no source repeated more than twice."""
    drawn = mixing.mix(_table(spark, sf_dir, "documents"), repetition=2.0)
    return drawn.select("doc_id", "source", "pass", "place")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.classify(docs, labels)


def op9_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt and two masked completions from every conversation and the one after it."""
    formatted = chat_format.format_pairs(chat_format.paired_conversations(_table(spark, sf_dir, "conversations")))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.start, s.end)), ",")
    return formatted.select(
        F.col("pair_id").alias("conv_id"), "prefix_turns", "prompt", "chosen", "rejected",
        joined("chosen_mask").alias("chosen_mask"), joined("rejected_mask").alias("rejected_mask"),
    )


def op10_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document and whether it is kept."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.resample(docs, labels).select("doc_id", "log_weight", "key", "kept")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and verification of every document."""
    return manifest.verify(manifest.document_manifest(_table(spark, sf_dir, "documents")))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document towards the benchmark's texts."""
    return crc_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_secret_scans": op5_secret_scans,
    "op6_warc_round_trip": op6_warc_round_trip,
    "op7_source_mixing": op7_source_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_preference_formatting": op9_preference_formatting,
    "op10_quality_resampling": op10_quality_resampling,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_simhash_near_dedup": op12_simhash_near_dedup,
    "op13_target_resampling": op13_target_resampling,
}

_PIECE = r"[^.,;:!?|\n]{0,80}[.,;:!?|\n]|[^.,;:!?|\n]{1,80}"


def _tree_sql(text: str) -> str:
    """Root hash of the paragraph and section tree."""
    paragraphs = f"list_transform(string_split({text}, chr(10)), lambda p: {{'h': sha256(p), 'e': p = ''}})"
    marked = f"list_transform({paragraphs}, lambda x: x.h || case when x.e or x.h[1] in ('0', '1') then ';' else ',' end)"
    sections = f"string_split(rtrim(array_to_string({marked}, ''), ',;'), ';')"
    return f"sha256(array_to_string(list_transform({sections}, lambda s: sha256(s)), ','))"


def _near_sql(a: str, b: str) -> str:
    total = lambda x: f"coalesce(list_sum(list_transform({x}, lambda s: length(s))), 0)"
    both = f"({total(a)} + {total(b)})"
    return f"case when {both} = 0 then 1.0 else 2 * {total(f'list_intersect({a}, {b})')} / {both} end::double"


#: Bit-wise CRC-32 of one more byte.
_CRC_STEP = "list_reduce([{state}, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"


def _crc_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, unsigned; ``crc_table`` holds the entry of every byte."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint"
    every = f"list_transform(range(0, octet_length(encode({text}))), lambda i: {byte})"
    step = "xor(c >> 8, entries[1 + (xor(c, b) & 255)])"
    return f"xor(list_reduce({every}, lambda c, b: {step}, 4294967295::bigint), 4294967295::bigint)"


_CRC_TABLE = f"""crc_table as (select list({_CRC_STEP.format(state='b')} order by b) as entries from range(0, 256) r(b))"""


def _leaf_sql(n_chars: str) -> str:
    text = lambda c: f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')"
    return "sha256(" + " || ".join(map(text, ["doc_id", "source", "lang", n_chars, "text"])) + ")"


def _rendered_sql(turns: str) -> str:
    """Turns in the chat template, the template's own marks in them broken up."""
    return f"array_to_string(list_transform({turns}, lambda t: {_turn_sql('t')}), '')"


def _plain_sql(text: str) -> str:
    return f"replace(replace({text}, '<|im_start|>', '<| im_start |>'), '<|im_end|>', '<| im_end |>')"


def _turn_sql(t: str) -> str:
    return f"'<|im_start|>' || {_plain_sql(t + '.role')} || chr(10) || {_plain_sql(t + '.text')} || '<|im_end|>' || chr(10)"


def _mask_sql(turns: str) -> str:
    """start:end of the assistant's words in the rendered turns."""
    sizes = f"list_transform({turns}, lambda t: length({_turn_sql('t')}))"
    start = f"coalesce(list_sum(({sizes})[1:i - 1]), 0)::bigint + length({_plain_sql(f'({turns})[i].role')}) + 13 - skip"
    end = f"list_sum(({sizes})[1:i])::bigint - 1 - skip"
    learnt = f"list_filter(range(1, len({turns}) + 1), lambda i: ({turns})[i].role = 'assistant')"
    return f"array_to_string(list_transform({learnt}, lambda i: ({start}) || ':' || ({end})), ',')"


def _features_sql(table: str, key: str) -> str:
    """(row, feature) with repeats, and the number of words of every row."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""(select row, n, unnest(list_concat(w, list_transform(range(1, n), lambda i: w[i] || ' ' || w[i + 1]))) as feature
      from (select row, w, len(w) as n from (select row_number() over (order by {key}, text) as row,
        regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from {table})))"""


ORACLE: dict[str, str] = {
    "op7_source_mixing": r"""
with d as (select doc_id, source,
        len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as tokens from documents),
s as (select source, sum(tokens)::double as tokens from d group by source),
a as (select 1 - least(1.0, ln(2.0) / ln(max(tokens) / min(tokens))) as alpha, sum(tokens) as n, max(tokens) as most from s),
q as (select source, tokens, pow(tokens / most, alpha - 1) as repeats from s, a),
p as (select source, floor(repeats + 1e-7)::int as passes,
        case when repeats - floor(repeats + 1e-7) > 1e-7 then (repeats - floor(repeats + 1e-7)) * tokens else 0 end as rest from q),
k as (select d.*, passes, rest, ('0x' || substr(md5('23:' || passes || ':' || doc_id), 1, 15))::bigint as key
      from d join p on d.source is not distinct from p.source),
r as (select *, sum(tokens) over (partition by source order by key) - tokens / 2 <= rest and rest > 0 as more from k),
c as (select doc_id, source, unnest(range(0, passes + more::int)) as pass from r)
select doc_id, source, pass::int as pass, ('0x' || substr(md5('23:' || pass || ':' || doc_id), 1, 15))::bigint as place from c""",
    "op6_warc_round_trip": """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha256(html) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1)
select d.page_id, payload_bytes, payload_digest,
       case when first <> d.page_id then 'revisit' else 'response' end as record_type,
       case when first <> d.page_id then first end as refers_to
from d left join f using (payload_digest)""",
    "op2_document_fingerprints": f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
n as (select doc_id, text, length(text) as n_chars,
        coalesce(lead(text) over (order by doc_id nulls first, text),
                 first_value(text) over (order by doc_id nulls first, text)) as after
      from d),
e as (select *, substr(text, 1, n_chars - n_chars // 2) || substr(after, 1, n_chars // 2) as edited from n),
l as (select *, list_distinct(regexp_extract_all(text, '{_PIECE}')) as own,
        list_distinct(regexp_extract_all(edited, '{_PIECE}')) as new,
        list_distinct(regexp_extract_all(after, '{_PIECE}')) as follow from e)
select doc_id, n_chars, sha256(edited) as edited_sha256, {_tree_sql('text')} as fingerprint,
       {_tree_sql('edited')} as edited_fingerprint, {_near_sql('own', 'new')} as near_edited,
       {_near_sql('own', 'follow')} as near_next
from l""",
    "op4_ngram_jaccard_join": r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents),
s as (
  select distinct doc_id, unnest(case when len(words) >= 5
      then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
      when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as gram,
    len(words) < 5 as short from w),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as common
      from s a join s b on a.gram = b.gram and a.short = b.short and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b
          where 100 * common >= 75 * (x.n + y.n - common)),
edges as (select a, b from links union select b, a from links),
reach as (select doc_id as a, doc_id as b from documents union select r.a, e.b from reach r join edges e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id
from documents d left join n using (doc_id)
join (select a, min(b) as component_id from reach group by a) c on c.a = d.doc_id""",
    "op9_preference_formatting": f"""
with c as (
  select conv_id, list({{'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')}}
                       order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as ts
  from conversations where conv_id is not null group by conv_id),
h as (select *, coalesce(list_position(list_transform(ts, lambda t: t.role), 'assistant'), 0) as first from c),
t as (select *, case when first = 0 then ts else ts[1:first - 1] end as head, case when first = 0 then [] else ts[first:] end as tail from h),
p as (select conv_id, ts as a, list_concat(head, coalesce(lead(tail) over w, first_value(tail) over w)) as b
      from t window w as (order by conv_id rows between unbounded preceding and unbounded following)),
n as (select *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: len(list_filter(range(1, i + 1),
        lambda j: a[j].role <> b[j].role or a[j].text <> b[j].text)) = 0))::int as prefix_turns from p),
r as (select conv_id, prefix_turns, a[1:prefix_turns] as common, a[prefix_turns + 1:] as x, b[prefix_turns + 1:] as y,
        coalesce(a[prefix_turns + 1].role = 'assistant' and b[prefix_turns + 1].role = 'assistant', false) as shared from n),
s as (select *, case when shared then 22 else 0 end as skip from r)
select conv_id, prefix_turns, {_rendered_sql('common')} || case when shared then '<|im_start|>assistant' || chr(10) else '' end as prompt,
  substr({_rendered_sql('x')}, skip + 1) as chosen, substr({_rendered_sql('y')}, skip + 1) as rejected,
  {_mask_sql('x')} as chosen_mask, {_mask_sql('y')} as rejected_mask from s""",
    "op11_merkle_manifest": f"""
with recursive {_CRC_TABLE},
f as (select doc_id, coalesce('1' || lang, '0') as tree, {_leaf_sql('n_chars')} as leaf,
        case when {_crc_sql('doc_id::varchar')} % 7 = 0 then {_leaf_sql('(n_chars + 1)')} end as changed
      from documents, crc_table),
p as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos,
        count(*) over (partition by tree) as n from f),
nodes as (
  select tree, 0 as level, pos, n, leaf as h from p
  union all
  select tree, level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' order by pos))
  from nodes where n > 1 group by tree, level, pos // 2),
subs as (select tree, h as subroot, row_number() over (order by tree) - 1 as pos, count(*) over () as n from nodes where n = 1),
tops as (
  select 0 as level, pos, n, subroot as h from subs
  union all
  select level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' order by pos)) from tops where n > 1 group by level, pos // 2),
-- A document's way up: its tree (part 0), then the tree of subroots (part 1).
ways as (
  select row_number() over (order by tree, pos) as row, tree, 0 as part, 0 as level, pos, n, coalesce(changed, leaf) as h, ''::varchar as proof from p
  union all
  select row, w.tree, case when w.n > 1 then w.part else 1 end, case when w.n > 1 then w.level + 1 else 0 end,
    case when w.n > 1 then w.pos // 2 else u.pos end, case when w.n > 1 then (w.n + 1) // 2 else u.n end,
    case when w.n > 1 then sha256(case when s.pos < w.pos then s.h else '' end || w.h || case when s.pos > w.pos then s.h else '' end)
         else w.h end,
    proof || case when w.n > 1 then coalesce(s.h, '') else '' end
  from ways w
  left join (select 0 as part, * from nodes union all select 1, '', level, pos, n, h from tops) s
    on w.n > 1 and s.part = w.part and s.level = w.level and s.pos = xor(w.pos, 1) and (w.part = 1 or s.tree = w.tree)
  join subs u on u.tree = w.tree
  where w.n > 1 or w.part = 0),
ends as (select row, h, proof from ways where part = 1 and n = 1),
numbered as (select row_number() over (order by tree, pos) as row, * from p),
root as (select h as root from tops where n = 1)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, e.h as folded_root, e.h = root as verified
from numbered join ends e using (row) join subs using (tree), root""",
    "op13_target_resampling": rf"""
with {_CRC_TABLE},
raw as {_features_sql('documents', 'doc_id')},
aim as {_features_sql('benchmark', 'item_id')},
hashed as (select feature, {_crc_sql('feature')} % 10000 as bucket
           from (select feature from raw union select feature from aim), crc_table),
s as (select bucket, count(*) as n from raw join hashed using (feature) group by bucket),
t as (select bucket, count(*) as n from aim join hashed using (feature) group by bucket),
sums as (select coalesce((select sum(n) from s), 0)::double as s_all, coalesce((select sum(n) from t), 0)::double as t_all),
gain as (select s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (s_all + 10000) / ((s.n + 1) * (t_all + 10000))))::bigint as gain
         from s left join t using (bucket), sums),
w as (select row, max(n) as words, count(*) as n_features, floor(sum(gain)::bigint / count(*))::bigint as weight
      from raw join hashed using (feature) join gain using (bucket) group by row),
d as (select row_number() over (order by doc_id, text) as row, doc_id,
        ('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from documents),
scored as (select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(words, 0) >= 20 as enough,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score
           from d left join w using (row)),
ranked as (select *, row_number() over (partition by enough order by score desc, doc_id nulls last) as r,
             count(*) over (partition by enough) as n from scored)
select doc_id, n_features, weight, score, case when enough and r <= 25 * n // 100 then r end as rank from ranked""",
}
