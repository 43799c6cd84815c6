"""Queries on texts, phrase lists and the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkspan.functions import text
from talkspan.operators import catalog
from talkspan.plans import fixtures as fx
from talkspan.plans.fixtures import sql
from talkspan.plans.registry import query

PALETTE = ("#1565C0", "#2E7D32", "#C62828", "#6A1B9A", "#EF6C00", "#00838F", "#AD1457", "#4E342E")


@query(sql(r"select conv_id, pos, regexp_replace(lower(trim(nfc_normalize(tok))), '[^\p{L}\p{Nd}_]', '', 'g') as word from fx_words", "fx_words"))
def normalize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.words(spark, sf_dir).select("conv_id", "pos", text.overlap_word(F.col("tok")).alias("word"))


_UP = "replace(upper({}), 'ẞ', 'SS')"  # sharp s has two capitals
_CASE = f"""case label when 'LOWER' then lower(t) when 'UPPER' then {_UP.format("t")} when 'CAPITAL' then {_UP.format("t[1:1]")} || t[2:]
  when 'CAPITAL_1' then case when length(t) > 1 then t[1:1] || {_UP.format("t[2:2]")} || t[3:] else t end
  when 'UPPER_-1' then case when length(t) > 1 then {_UP.format("t[1:length(t) - 1]")} || right(t, 1) else t end else t end"""


@query(sql(f"""
select conv_id, pos, label, {_CASE} as changed from
  (select conv_id, pos, tok as t, ['LOWER', 'UPPER', 'CAPITAL', 'CAPITAL_1', 'UPPER_-1', 'KEEP'][pos % 6 + 1] as label from fx_words)""", "fx_words"))
def case_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.element_at(F.array(*map(F.lit, ("LOWER", "UPPER", "CAPITAL", "CAPITAL_1", "UPPER_-1", "KEEP"))), (F.col("pos") % 6 + 1).cast("int"))
    w = fx.words(spark, sf_dir).withColumn("label", labels)
    return w.select("conv_id", "pos", "label", text.change_case(F.col("tok"), F.col("label")).alias("changed"))


@query(r"""
with d as (select doc_id, regexp_replace(replace(text, ':', ' '), '(\s*,)+', ',', 'g') as t from documents),
e as (select doc_id, regexp_replace(regexp_replace(t, '\.{4,}', '...', 'g'), ',\s*\.', '.', 'g') as t from d)
select doc_id, length(t) - length(replace(t, ',', '')) as commas, length(t) as n, sha256(t) as digest from e""")
def collapse_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of tidy_marks() that RE2 can express."""
    t = F.regexp_replace(F.regexp_replace(F.col("text"), ":", " "), r"(\s*,)+", ",")
    t = F.regexp_replace(F.regexp_replace(t, r"\.{4,}", "..."), r",\s*\.", ".")
    d = fx.table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", (F.length("t") - F.length(F.replace("t", F.lit(",")))).alias("commas"), F.length("t").alias("n"), F.sha2("t", 256).alias("digest"))


_WS = r"[ \t\n\x0B\f\r]"


@query(rf"""
with a as (select doc_id, regexp_replace(regexp_replace(replace(text, ':', ' '), '({_WS}*,)+', ',', 'g'), '\.{{4,}}', '...', 'g') as t from documents),
b as (select doc_id, regexp_replace(regexp_replace(t, ',{_WS}*\.', '.', 'g'), '([,?]){_WS}*', '\1 ', 'g') as t from a),
c as (select doc_id, regexp_replace(regexp_replace(t, '\.{_WS}+', '. ', 'g'), '\.([^. \t\n\x0B\f\r])', '. \1', 'g') as t from b),
d as (select doc_id, regexp_replace(regexp_replace(t, '{_WS}+([,.?])', '\1', 'g'), '^{_WS}*,{_WS}*', '') as t from c),
e as (select doc_id, trim(regexp_replace(t, '{_WS}+', ' ', 'g')) as t from d),
f as (select doc_id, list_filter(string_split(regexp_replace(t, '([.?!]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as l from e),
g as (select doc_id, list_transform(l, lambda x: case when instr(x, ',') > 0 and len(list_filter(string_split(x, ' '), lambda y: y <> '')) < 8
    then left(x, instr(x, ',')) || replace(substr(x, instr(x, ',') + 1), ',', '') else x end) as l from f)
select doc_id, array_to_string(list_transform(l, lambda x: replace(upper(x[1:1]), 'ẞ', 'SS') || x[2:]), ' ') as polished from g""")
def post_process_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.polish(F.col("text")).alias("polished"))


_PHRASE = r"""
p as (select pos, replace(upper(regexp_replace(trim(case when m <> '' then regexp_extract(line, '^(.*):\s*[-+]?[0-9]*\.?[0-9]+\s*$', 1) else line end), '\s+', ' ', 'g')), 'ẞ', 'SS') as phrase,
    least(8.0e0, greatest(0.0e0, coalesce(try_cast(nullif(m, '') as double), 1.5e0))) as score
  from (select pos, line, regexp_extract(line, '^(.*):\s*([-+]?[0-9]*\.?[0-9]+)\s*$', 2) as m from fx_hotword_lines where trim(line) <> '' and not starts_with(trim(line), '#')))"""


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.hotword_lines(spark, sf_dir).where(text.is_phrase_line(F.col("line")))
    phrase, score = text.phrase_score(F.col("line"), 1.5)
    return lines.select("pos", phrase.alias("phrase"), score.alias("score"))


@query(sql(f"with {_PHRASE} select * from p order by pos limit 1000", "fx_hotword_lines"))
def hotword_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most the first 1000 phrases: a limit of the list itself."""
    return phrases(spark, sf_dir).orderBy("pos").limit(1000)


@query(sql(f"""with {_PHRASE} select pos, phrase || ' :' || case when contains(printf('%.2f', score), '.') then regexp_replace(printf('%.2f', score), '\\.?0+$', '') else printf('%.2f', score) end as line from p""", "fx_hotword_lines"))
def hotword_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(spark, sf_dir).select("pos", F.concat("phrase", F.lit(" :"), text.score_text(F.col("score"))).alias("line"))


@query(sql(f"with {_PHRASE}, f as (select phrase, min(pos) as pos from p group by all) select p.pos, p.phrase, score from p join f on p.phrase = f.phrase and p.pos = f.pos", "fx_hotword_lines"))
def hotword_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal phrases stays."""
    g = phrases(spark, sf_dir).groupBy("phrase").agg(F.min(F.struct("pos", "score")).alias("f"))
    return g.select("f.pos", "phrase", "f.score")


@query(sql(f"with {_PHRASE} select count(*) filter (contains(phrase, 'TH')) as visible, count(*) as total from p", "fx_hotword_lines"))
def hotword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(spark, sf_dir).agg(F.count_if(F.contains("phrase", F.lit("TH"))).alias("visible"), F.count("*").alias("total"))


#: Letters beyond ASCII as capitals and control characters, as words hold neither and levenshtein() counts bytes.
_ALIGN = r"""
t as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}_]+'), lambda x: x <> '') as w from benchmark where text is not null),
odd as (select coalesce(string_agg(c, '' order by c), '') as s from (select distinct unnest(regexp_extract_all(array_to_string(w, ''), '[^a-z0-9_]')) as c from t)),
plain as (select item_id, list_transform(w, lambda x: translate(x, odd.s, array_to_string(list_transform(list_concat(range(65, 91), range(1, 32)), lambda k: chr(cast(k as integer))), ''))) as w from t, odd where len(w) > 0),
a as (select item_id, w[greatest(1, (len(w) * 3 + 4) // 5 - 99) : (len(w) * 3 + 4) // 5] as tails, w[len(w) * 2 // 5 + 1 : len(w) * 2 // 5 + 100] as heads from plain),
tail as (select item_id, unnest(range(len(tails))) as i, unnest(tails) as tok from a), head as (select item_id, unnest(range(len(heads))) as i, unnest(heads) as tok from a),
m as (select t.item_id, h.i - t.i as off_, count(*) filter (t.tok = h.tok or (length(t.tok) > 2 and length(h.tok) > 2 and (contains(t.tok, h.tok) or contains(h.tok, t.tok)))
   or 1 - levenshtein(t.tok, h.tok) / greatest(length(t.tok), length(h.tok)) >= 0.8) as matches, count(*) as pairs from tail t join head h on t.item_id = h.item_id group by all)"""


@query(f"with {_ALIGN} select item_id, off_ as offset_, matches, pairs from m where matches > 0 qualify row_number() over (partition by item_id order by matches / pairs desc, off_) <= 3")
def fuzzy_offset_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into two parts that share a fifth: the last words of the first part and the first of the second (100
    at most, as far as alignment looks) laid over each other at every offset; matches by offset, and the best three."""
    parts = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{Nd}_]+"), lambda x: x != "")
    b = fx.table(spark, sf_dir, "benchmark").select("item_id", parts.alias("w")).withColumn("n", F.size("w")).where("n > 0")
    end = F.floor((F.col("n") * 3 + 4) / 5).cast("int")
    begin = F.greatest(F.lit(0), end - 100)
    tail = b.select("item_id", F.posexplode(F.slice("w", begin + 1, end - begin)).alias("i", "tok"))
    head = b.select("item_id", F.posexplode(F.slice("w", F.floor(F.col("n") * 2 / 5).cast("int") + 1, 100)).alias("j", "other"))
    pairs = tail.join(head, "item_id").groupBy("item_id", (F.col("j") - F.col("i")).alias("offset_"))
    m = pairs.agg(F.count_if(text.words_match(F.col("tok"), F.col("other"))).alias("matches"), F.count("*").alias("pairs")).where("matches > 0")
    best = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(F.col("matches") / F.col("pairs")), "offset_"))
    return m.withColumn("r", best).where("r <= 3").drop("r")


@query(sql("""select id, lower(trim(display_name)) as key, regexp_replace(original_name, '(.)\\.[^.]*$', '\\1') as base, regexp_extract(original_name, '.\\.([^./]+)$', 1) as ext,
  case when length(display_name) > 6 then left(display_name, 6) || '...' else display_name end as short,
  case when source_bytes >= 1024 then printf('%.1f', floor(source_bytes * 10 / 1024 + 0.5) / 10) || ' KB' else source_bytes || ' B' end as size,
  lpad(cast(source_bytes // 60 as varchar), cast(greatest(2, length(cast(source_bytes // 60 as varchar))) as integer), '0') || ':' || lpad(cast(source_bytes % 60 as varchar), 2, '0') as clock,
  '#' || upper(lpad(to_hex(source_bytes % 16777216), 6, '0')) as colour, 'Người nói ' || (source_bytes % 7 + 1) as label from fx_library""", "fx_library"))
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("source_bytes")
    return fx.library(spark, sf_dir).select(
        "id", text.search_key(F.col("display_name")).alias("key"), text.base_name(F.col("original_name")).alias("base"), text.extension(F.col("original_name")).alias("ext"),
        text.abbreviate(F.col("display_name"), 6).alias("short"), text.byte_size(n).alias("size"), text.clock(n).alias("clock"), text.colour(n).alias("colour"), text.speaker_label(n % 7).alias("label"),
    )


@query(sql("""select conv_id, pos, tok in (':', '.', ',', '?') as mark, regexp_matches(tok, '[.!?:;]["'')\\]]*$') as ends, length(tok) - length(replace(tok, 'e', '')) as e_count from fx_words""", "fx_words"))
def word_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tok")
    return fx.words(spark, sf_dir).select("conv_id", "pos", text.is_mark(t).alias("mark"), text.ends_sentence(t).alias("ends"), (F.length(t) - F.length(F.replace(t, F.lit("e")))).alias("e_count"))


@query("""
with l as (select event_id, ['$APPEND_.', '$APPEND_;', '$TRANSFORM_CASE_UPPER', '$DELETE', '$APPEND_?', '$TRANSFORM_CASE_CAPITAL_1', '$KEEP'][event_id % 7 + 1] as label from events)
select event_id, case when regexp_matches(label, '^\\$APPEND_[:.,?]$') then 'append' when starts_with(label, '$TRANSFORM_CASE_') then 'case' end as kind,
  case when regexp_matches(label, '^\\$APPEND_[:.,?]$') then label[9:] when starts_with(label, '$TRANSFORM_CASE_') then label[17:] end as arg from l""")
def edit_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ("$APPEND_.", "$APPEND_;", "$TRANSFORM_CASE_UPPER", "$DELETE", "$APPEND_?", "$TRANSFORM_CASE_CAPITAL_1", "$KEEP")
    e = fx.table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, labels)), (F.col("event_id") % 7 + 1).cast("int")).alias("label"))
    return e.select("event_id", text.edit_kind(F.col("label")).alias("x")).select("event_id", "x.kind", "x.arg")


@query(sql("select * from fx_library where contains(lower(display_name || ' ' || original_name || ' ' || status), 'src1')", "fx_library"))
def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search(fx.library(spark, sf_dir), "  SRC1 ")


@query(sql("select id, row_number() over (order by updated_ms desc, id) as place from fx_library order by updated_ms desc, id limit 50", "fx_library"))
def library_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = catalog.newest(fx.library(spark, sf_dir), 50)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("updated_ms"), "id")).cast("long").alias("place"))


@query(sql("select l.* from fx_library l where status = 'processing' and cast(id as bigint) % 3 <> 0 order by updated_ms desc, id limit 1", "fx_library"))
def library_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest item in process without a result."""
    items = fx.library(spark, sf_dir)
    results = items.where("cast(id as bigint) % 3 = 0").select("id")
    return catalog.newest(catalog.unfinished(items, results), 1).select(items.columns)


@query(sql("""select id, display_name, original_name, case when cast(id as bigint) % 5 = 0 then 'error' else status end as status, source_bytes,
  case when cast(id as bigint) % 5 = 0 then 1800000000000 else updated_ms end as updated_ms from fx_library""", "fx_library"))
def library_status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fx.library(spark, sf_dir)
    changes = items.where("cast(id as bigint) % 5 = 0").select("id", F.lit("error").alias("status"), F.lit(1800000000000).alias("updated_ms"))
    return catalog.set_status(items, changes)


@query(sql("select * from fx_library where not (status = 'cancelled')", "fx_library"))
def library_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fx.library(spark, sf_dir)
    return catalog.delete(items, items.where("status = 'cancelled'")).select(items.columns)


@query("select p_partkey as id from part where p_partkey % 3 <> 0 and not exists (select 1 from supplier where s_suppkey = p_partkey)")
def missing_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = fx.table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"))
    return catalog.missing(required, fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), "id")


@query("select s_suppkey as id from supplier where s_suppkey in (select p_partkey from part where p_size < 25)")
def selected_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fx.table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("id"))
    return catalog.selected(fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), items)


@query(sql("select id from fx_library where status = 'error' union select id from fx_library where source_bytes > 2000 except select id from fx_library where status = 'complete'", "fx_library"))
def selection_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fx.library(spark, sf_dir)
    ids = lambda where: items.where(where).select("id")
    return catalog.toggle(catalog.toggle(ids("status = 'error'"), ids("source_bytes > 2000"), True), ids("status = 'complete'"), False)


@query(sql(f"""select t.item_id, t.turn_no, t.speaker, case t.speaker when 1 then 'Lan' else 'Người nói ' || (t.speaker + 1) end as name,
  case t.speaker when 1 then '#000000' else {list(PALETTE)}[t.speaker % 8 + 1] end as color from fx_turns t""", "fx_turns"))
def speaker_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    speakers = spark.createDataFrame([(1, "Lan", "#000000")], "speaker int, name string, color string")
    return catalog.with_speakers(fx.turns(spark, sf_dir).select("item_id", "turn_no", "speaker"), speakers, PALETTE)


@query(sql("""select w.conv_id, w.pos, coalesce(v.id, 0) as id from fx_words w left join
  (select tok, row_number() over (order by tok) as id from (select tok from fx_words group by tok having count(*) >= 5)) v on w.tok = v.tok""", "fx_words"))
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of words in a vocabulary; 0 for unknown ones."""
    w = fx.words(spark, sf_dir).select("conv_id", "pos", "tok")
    vocab = w.groupBy("tok").agg(F.count("*").alias("n")).where("n >= 5").select("tok", F.row_number().over(Window.orderBy("tok")).cast("long").alias("id"))
    return w.join(vocab, "tok", "left").select("conv_id", "pos", F.coalesce("id", F.lit(0).cast("long")).alias("id"))


@query("""select chunk, frame, b0, b1, b2 from (select event_id // 20 as chunk, event_id % 20 as frame, [0,1,0,0,1,1,0][event_id % 7 + 1] as b0, [0,0,1,0,1,0,1][event_id % 7 + 1] as b1, [0,0,0,1,0,1,1][event_id % 7 + 1] as b2 from events)""")
def powerset_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of up to two of three speakers, as bits."""
    classes = ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1))
    at = (F.col("event_id") % 7 + 1).cast("int")
    bits = [F.element_at(F.array(*[F.lit(c[s]) for c in classes]), at).alias(f"b{s}") for s in range(3)]
    return fx.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 20).alias("chunk"), (F.col("event_id") % 20).alias("frame"), *bits)


@query(sql("select id, strftime(make_timestamp(updated_ms * 1000), '%-d/%-m/%Y %H:%M') as shown, updated_ms from fx_library", "fx_library"))
def display_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.library(spark, sf_dir).select("id", F.date_format(F.timestamp_millis("updated_ms"), "d/M/yyyy HH:mm").alias("shown"), "updated_ms")
