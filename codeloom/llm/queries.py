"""One query per operator of this subpackage, over its whole table, with production parameters; and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bitplanes, chosen_path, curriculum, gam_classifier, grouped_ranking, license_scan, line_frequency, minhash, phrase_index, site_spread, spelling_groups, unit_dedup, warc
from codeloom.llm.common import table


def tokenizer_path() -> str:
    from public_tokenizers import path

    return path("word_bpe_49k.json")


def op1_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bitplanes.tokens_to_shards(docs, tokenizer_path(), end_id=1).drop("shard")


def op2_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.repeated_spans(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
with d as (select row_number() over (order by doc_id nulls last, md5(text)) r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
p as (select r, unnest(x) u, generate_subscripts(x, 1) k from (select r, regexp_extract_all(t, '\n|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+') x from d)),
o as (
  select *, coalesce(sum(length(u)) over (w rows between unbounded preceding and 1 preceding), 0) a, regexp_matches(u, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]') is_word,
    count(*) filter (u = chr(10)) over w line, count(*) filter (regexp_matches(u, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]')) over w n
  from p window w as (partition by r order by k)),
words as (select r, line, n - 1 word, a, a + length(u) b, u from o where is_word),
units as (
  select r, min(n) filter (is_word) - 1 word, max(n) filter (is_word) stop_word, min(a) a, max(a + length(u)) b, string_agg(u, ' ' order by k) filter (is_word) v
  from o where u <> chr(10) group by r, line having count(*) filter (is_word) > 0),
found_units as (
  select *, min(r) over (partition by v) keeper, row_number() over (partition by r, v order by word) nth from units),
pieces as (select r, word, stop_word, a, b, 1 n_units, keeper from found_units where keeper <> r or nth > 1),
marked as (select *, case when word > max(stop_word) over (partition by r order by word rows between unbounded preceding and 1 preceding) then 1 else 0 end gap from pieces),
unit_runs as (select r, min(word) word, max(stop_word) stop_word, min(a) a, max(b) b, sum(n_units) n_units, min(keeper) keeper
  from (select *, sum(gap) over (partition by r order by word rows unbounded preceding) run from marked) group by r, run),
win as (
  select r, word, a, last_b b, v from (
    select r, word, a, lead(b, 49) over w last_b, string_agg(u, ' ') over (partition by r order by word rows between current row and 49 following) v
    from words window w as (partition by r order by word)) where last_b is not null),
found_win as (select *, min(r) over (partition by v) keeper, min(word) over (partition by r, v) first_word from win),
open_win as (
  select w.r, w.word, w.word + 50 stop_word, w.a, w.b, 0 n_units, keeper from found_win w where (keeper <> r or word - first_word >= 50)
    and not exists (select 1 from unit_runs u where u.r = w.r and u.word <= w.word and u.stop_word >= w.word + 50)),
every as (select r, word, stop_word, a, b, n_units, keeper from unit_runs union all select * from open_win),
apart as (select *, case when word > max(stop_word) over (partition by r order by word, n_units rows between unbounded preceding and 1 preceding) then 1 else 0 end gap from every),
runs as (select r, min(word) word, max(stop_word) stop_word, min(a) a, max(b) b, sum(n_units) n_units, min(keeper) keeper
  from (select *, sum(gap) over (partition by r order by word, n_units rows unbounded preceding) run from apart) group by r, run)
select d.doc_id, runs.a::int start, runs.b::int stop, n_units::bigint n_units, (stop_word - word)::bigint n_words, k.doc_id first_doc_id
from runs join d using (r) join d k on k.r = runs.keeper
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op4_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"), min_revisit_bytes=0)


OP4_SQL = """
with p as (select page_id, coalesce(html, '') html from pages),
d as (
  select page_id, strlen(html)::bigint payload_bytes, sha1(html) h, count(*) over (partition by html) n, max(page_id) over (partition by html) top
  from p)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (1 + 10 * (i // 8))::int, 10))::bigint >> (35 - 5 * (i % 8))::int) & 31)::int + 1, 1)), '') payload_digest,
  case when n > 1 and page_id <> top then 'revisit' else 'response' end record_type,
  case when n > 1 and page_id <> top then top end refers_to
from d
"""


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.quality(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
with d as (select row_number() over () r, doc_id, source, coalesce(text, '') t from documents),
w as (select r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) k from d),
win as (
  select r, k, w || ' ' || lead(w, 1) over x || ' ' || lead(w, 2) over x || ' ' || lead(w, 3) over x || ' ' || lead(w, 4) over x v
  from w window x as (partition by r order by k)),
twice as (select r, k from (select r, k, count(*) over (partition by r, v) n from win where v is not null) where n > 1),
rep as (select r, count(distinct k + j) n from twice, range(5) t(j) group by r),
l as (select r, source, line from (select r, source, unnest(string_split(t, chr(10))) line from d) where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select r, count(*) - count(distinct line) n from l group by r),
norm as (
  select r, source, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) words
  from l),
hosts as (select source, count(*) docs from d group by source),
freq as (
  select c.source, c.line from (select source, line, count(distinct r) n from norm group by all) c
  join hosts h on c.source is not distinct from h.source where n > 20 and n > 0.02 * docs),
gone as (select n.r, sum(words) n from norm n join freq f on n.source is not distinct from f.source and n.line = f.line group by n.r),
counts as (select r, count(*) n, sum(length(w)) chars from w group by r),
facts as (
  select d.doc_id, coalesce(c.n, 0)::bigint n_words, coalesce(c.chars, 0)::bigint word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols, coalesce(dup.n, 0)::bigint n_dup_lines,
    coalesce(rep.n, 0)::bigint n_repeat_words, coalesce(gone.n, 0)::bigint n_removed_words
  from d left join counts c using (r) left join dup using (r) left join rep using (r) left join gone using (r)),
base as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed, n_words - n_removed_words rest from facts)
select * exclude (rest), not base_failed and rest >= 10 and rest >= 0.3 * n_words kept from base
"""


def op7_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


OP8_SQL = r"""
with recursive d as (select row_number() over () r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
s as (select distinct r, array_to_string(list_slice(w, k, k + least(5, len(w)) - 1), ' ') v
  from (select r, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) k from d where len(w) > 0)),
n as (select r, count(*) n from s group by r),
c as (select a.r a, b.r b, count(*) c from s a join s b using (v) where a.r <> b.r group by all),
e as (select a, b from c join n x on a = x.r join n y on b = y.r where 5 * c >= 4 * (x.n + y.n - c)),
reach as (select a, b from e union select reach.a, e.b from reach join e on reach.b = e.a),
low as (select a r, min(doc_id) m from (select a, b from reach union select r, r from d) z join d on z.b = d.r group by a),
k as (select a r, count(*) n from e group by a)
select doc_id, low.m class_id, coalesce(k.n, 0)::bigint n_links from d join low using (r) left join k using (r)
"""


def op9_phrase_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
with i as (select row_number() over () q, coalesce(item_id::varchar, 'null') item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
size as (select q, item, w, least(13, len(w)) n from i where len(w) > 0),
win as (select distinct item, n, array_to_string(list_slice(w, k, k + n - 1), ' ') v from (select item, w, n, unnest(range(1, len(w) - n + 2)) k from size)),
d as (select row_number() over () r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
places as (select r, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') v
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) k from d, (select distinct n from size) s where len(w) >= n)),
m as (select r, a.k, a.n, item from places a join win using (n, v)),
h as (select r, count(distinct k + j) n_hit from (select r, k, unnest(range(0, n)) j from m) group by r),
t as (select r, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items from m group by r),
occ as (select r, unnest(w) u, generate_subscripts(w, 1) k from d),
f as (select u, count(*) c from occ group by u),
wins as (select row_number() over () id, item, n, v from win),
placed as (select id, item, n, string_split(v, ' ')[j] u, j from (select id, item, n, v, unnest(range(1, n + 1)) j from wins)),
rare as (select id, item, n, u, j from (select p.*, c, min(coalesce(c, 0)) over (partition by id) least from placed p left join f using (u)) where least > 0 qualify row_number() over (partition by id order by c, j) = 1),
cand as (select distinct id, item, n, o.r, o.k - a.j + x s from rare a join occ o using (u), range(-2, 3) g(x)),
close as (select c.r, c.item, c.id, c.s, c.n, count(distinct p.j) got from cand c join placed p on p.id = c.id join occ o on o.r = c.r and o.u = p.u and o.k between c.s + p.j - 2 and c.s + p.j + 2 group by all),
nears as (select r, count(distinct item) n_near from close where got = n group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256,
  coalesce(n_near, 0)::bigint n_near, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join h using (r) left join t using (r) left join nears using (r)
"""


def op10_site_spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = site_spread.spread_report(table(spark, sf_dir, "documents"))
    return report.withColumn("removed", F.array_join(F.transform("removed", lambda k: k.cast("string")), ","))


OP10_SQL = r"""
with d as (select row_number() over () r, doc_id, source, string_split(coalesce(text, ''), chr(10)) lines from documents),
l as (select r, source, unnest(lines) line, generate_subscripts(lines, 1)::int - 1 k from d),
n as (select r, source, k, length(line) chars, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) line from l),
boiler as (select line from n where line <> '' group by line having count(distinct coalesce('=' || source, '')) >= 8),
gone as (select r, list(k order by k) removed, sum(chars + 1) chars from n join boiler using (line) group by r),
total as (select r, sum(chars + 1) chars from n group by r)
select doc_id, len(lines)::bigint n_lines, coalesce(len(removed), 0)::bigint n_removed, array_to_string(coalesce(removed, []), ',') removed,
  greatest(0, t.chars - coalesce(g.chars, 0) - 1)::bigint clean_chars
from d join total t using (r) left join gone g using (r)
"""


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curriculum.curriculum(table(spark, sf_dir, "documents"))
    ends = {n: F.round(n, 9) for n in ("first_position", "last_position")}
    return rows.withColumns(ends).select("doc_id", "size", "source_size", "target", "taken", "copies", *ends)


OP6_SQL = r"""
with sizes as (
  select row_number() over () r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
    ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::varchar, ''), coalesce(strlen(text), 0)::varchar, '17')), 1, 14))::bigint ord
  from documents),
per as (select source, sum(size)::bigint source_size, 3.0 * sum(size)::double cap from sizes group by source),
weighed as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double weight from per),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) lvl from weighed),
best_level as (select *, max(case when lvl * weight <= cap then lvl end) over () best from levels),
targets as (select source, source_size, weight, least(cap, coalesce(best * weight, cap))::double target from best_level),
placed as (
  select s.*, t.source_size, t.target, t.weight,
    coalesce(sum(size) over (partition by s.source order by ord, doc_id, size rows between unbounded preceding and 1 preceding), 0) + size / 2 mid
  from sizes s join targets t on s.source is not distinct from t.source),
counted as (select *, (case when size > 0 then least(3, greatest(0, ceil((target - mid) / source_size))) else 0 end)::bigint copies from placed),
ends as (select *, least(1.0, mid / target) done1, least(1.0, (mid + (copies - 1) * source_size) / target) done2 from counted),
parts as (select * from (values (1, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0), (2, 0.0, 0.0, 1.0, 0.5, 1.0, 1.0), (3, 0.0, 0.0, 0.5, 0.2, 1.2, 1.0), (3, 0.25, 0.5, 0.5, 0.8, 2.8, 1.0)) v(weight, passed, start, length, height, slope, area)),
timed as (
  select r, which, start + least(length, 2 * (w - passed) / (height + sqrt(height * height + 2 * slope * (w - passed)))) time
  from (select r, which, done * area::double w, passed::double passed, start::double start, length::double length, height::double height, slope::double slope
    from (select r, weight, 1 which, done1 done from ends where copies > 0 union all select r, weight, 2, done2 from ends where copies > 0) e join parts using (weight)
    where done * area >= passed qualify row_number() over (partition by r, which order by passed desc) = 1))
select e.doc_id, size, source_size, target, size * copies taken, copies, round(a.time, 9) first_position, round(b.time, 9) last_position
from ends e left join timed a on a.r = e.r and a.which = 1 left join timed b on b.r = e.r and b.which = 2
"""


def op11_counting_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_ranking.sale_lines_ranked(table(spark, sf_dir, "sale_lines"))


OP11_SQL = r"""
with recursive bits as (select i, i c, 0 k from range(256) r(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
crcs as (select list(c order by i) v from bits where k = 8),
ids as (select sale_id, xor(list_reduce(list_transform(string_split(sale_id::varchar, ''), lambda x: ascii(x)::bigint), lambda c, b: xor(c >> 8, v[xor(c, b) % 256 + 1]), 4294967295::bigint), 4294967295) crc
  from (select distinct sale_id from sale_lines where sale_id is not null), crcs),
l as (
  select coalesce(crc % 5 = 0, false) one, vendor_id, coalesce(item_id % 2, -1) part, coalesce(100 * year(shipped_at) + month(shipped_at), -1) m, sale_id, line_no::bigint line_no, quantity::bigint quantity,
    floor(quantity / 10)::bigint tens, floor(100 * discount + 0.5)::bigint percent, floor(100 * amount + 0.5)::bigint amount_cents
  from sale_lines left join ids using (sale_id)),
g as (select case when one then -1 else vendor_id end::bigint vendor_id, case when one then -1 else part end::bigint part, case when one then -1 else m end::bigint as month, sale_id, line_no, quantity, tens, percent, amount_cents from l),
r as (
  select *, dense_rank() over (partition by vendor_id, part, month order by tens desc nulls last, percent nulls last) place,
    row_number() over (partition by vendor_id, part, month order by tens desc nulls last, percent nulls last, sale_id nulls last, line_no nulls last, quantity nulls last, amount_cents nulls last) pos,
    count(*) over (partition by vendor_id, part, month, tens, percent) tied from g)
select vendor_id, part, month, pos, place, sale_id, line_no, quantity, percent, amount_cents, tied from r where place <= 5
"""


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.variants(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with recursive bits as (select i, i c, 0 k from range(256) r(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
crcs as (select list(c order by i) v from bits where k = 8),
runs as (select coalesce(doc_id::varchar, '') d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') r from documents),
counted as (select d, r, count(*) c from runs group by all),
hex as (select d, r, c, hex(encode(d || ':' || r)) x from counted),
h as (select d, r, c, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::bigint), lambda a, b: xor(a >> 8, v[xor(a, b) % 256 + 1]), 4294967295::bigint), 4294967295) h from hex, crcs),
made as (select case when h % 97 = 0 then substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) else r end word, c from h),
words as (select word, sum(c)::bigint n from made where length(word) >= 5 group by word having sum(c) >= 3),
places as (select word, n, unnest(range(1, length(word) + 1)) i from words),
holes as (select word, n, i, substr(word, 1, i - 1) a, substr(word, i + 1) b from places),
near as (
  select x.word, y.word other, y.n other_n from holes x join holes y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word
  union select x.word, y.word, y.n from holes x join words y on y.word = x.a || x.b
  union select y.word, x.word, x.n from holes x join words y on y.word = x.a || x.b),
said as (select word, count(*) n_near, arg_min(other, (-other_n, other)) form, max(other_n) form_n from near group by word),
forms as (select word, form, form_n from said join words using (word) where form_n >= 2 * n),
walk as (select word, form root, 1 k from forms union all select w.word, f.form, k + 1 from walk w join forms f on f.word = w.root),
ends as (select word, arg_max(root, k) root from walk group by word)
select word, n, form, coalesce(root, word) root, coalesce(n_near, 0) n_near, forms.form_n
from words left join (select word, n_near from said) using (word) left join forms using (word) left join ends using (word)
"""


def op13_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with recursive d as (select row_number() over () r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) w from documents),
s as (select distinct r, array_to_string(list_slice(w, k, k + least(5, len(w)) - 1), ' ') v
  from (select r, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) k from d where len(w) > 0)),
n as (select r, count(*) n from s group by r),
c as (select a.r a, b.r b, count(*) c from s a join s b using (v) where a.r <> b.r group by all),
e as (select a, b from c join n x on a = x.r join n y on b = y.r where 100 * c >= 85 * (x.n + y.n - c)),
reach as (select a, b from e union select reach.a, e.b from reach join e on reach.b = e.a),
low as (select a r, min(doc_id) m from (select a, b from reach union select r, r from d) z join d on z.b = d.r group by a)
select doc_id, coalesce(n.n, 0)::bigint n_shingles, low.m component_id, doc_id is not distinct from low.m kept from d join low using (r) left join n using (r)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bitplane_tokens": op1_bitplane_tokens,
        "op2_unit_dedup": op2_unit_dedup,
        "op3_license_scan": op3_license_scan,
        "op4_warc_capture_index": op4_warc_capture_index,
        "op5_line_frequency": op5_line_frequency,
        "op6_curriculum_mix": op6_curriculum_mix,
        "op7_gam_quality": op7_gam_quality,
        "op8_chosen_path_join": op8_chosen_path_join,
        "op9_phrase_decontamination": op9_phrase_decontamination,
        "op10_site_spread_lines": op10_site_spread_lines,
        "op11_counting_rank": op11_counting_rank,
        "op12_spelling_groups": op12_spelling_groups,
        "op13_minhash_components": op13_minhash_components,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_unit_dedup": OP2_SQL,
        "op4_warc_capture_index": OP4_SQL,
        "op5_line_frequency": OP5_SQL,
        "op6_curriculum_mix": OP6_SQL,
        "op8_chosen_path_join": OP8_SQL,
        "op9_phrase_decontamination": OP9_SQL,
        "op10_site_spread_lines": OP10_SQL,
        "op11_counting_rank": OP11_SQL,
        "op12_spelling_groups": OP12_SQL,
        "op13_minhash_components": OP13_SQL,
    }
