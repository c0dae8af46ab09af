"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

from __future__ import annotations

from ledgerlens.llm import mixing, quality

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _quality() -> str:
    broken = []
    for rule in quality.RULES:
        tests = [f"{rule.metric} < {rule.low}"] * (rule.low is not None)
        tests += [f"{rule.metric} > {rule.high}"] * (rule.high is not None)
        broken.append(f"case when {' or '.join(tests)} then '{rule.name}' end")
    share = "case when {1} > 0 then {0} / {1}::double else 0.0 end".format
    return rf"""
with split as (
  select doc_id, coalesce(text, '') as text, {WORDS} as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
counted as (
  select doc_id, words, len(words)::bigint as n_words, len(lines)::bigint as n_lines,
    length(array_to_string(words, ''))::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    len(list_filter(lines, lambda x: contains(x, '|'))) as n_table_lines,
    len(list_filter(words, lambda w: lower(w) in ({_quoted(quality.STOP_WORDS)}))) as n_stop_words,
    len(list_filter(words, lambda w: length(w) > 1 and w = upper(w) and w <> lower(w) and not contains(w, 'ß'))) as n_shouted
  from split),
windows as (
  select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w
  from (select doc_id, words, unnest(generate_series(1, len(words) - 2)) as i from counted)),
repeats as (
  select doc_id, i from windows qualify count(*) over (partition by doc_id, w) > 1),
covered as (
  select doc_id, count(distinct i + k) as n
  from repeats cross join (values (0), (1), (2)) as steps(k) group by doc_id),
metrics as (
  select c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
    {share("word_chars", "n_words")} as mean_word_chars, {share("n_symbols", "n_words")} as symbols_per_word,
    {share("n_stop_words", "n_words")} as stop_word_ratio, {share("n_dup_lines", "n_lines")} as dup_line_ratio,
    {share("n_table_lines", "n_lines")} as table_line_ratio, {share("n_shouted", "n_words")} as shouted_ratio
  from counted c left join covered using (doc_id)),
judged as (
  select *, n_words < {quality.BASE_MIN_WORDS}
      or 100 * n_repeat_words > {quality.BASE_MAX_REPEAT_PERCENT} * n_words as base_failed,
    concat_ws(',', {', '.join(broken)}) as failed_rules
  from metrics)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and failed_rules = '' as kept, failed_rules
from judged"""


def _mixing() -> str:
    return f"""
with recursive counts as (
  select source, count(*) as n, sqrt(count(*)) as weight from documents group by source),
rates as (
  select source, weight * sum(n) over () / sum(weight) over () / n as rate from counts),
parts as (
  select source, rate, greatest(1, ceil(rate / {mixing.PART_MEAN}))::int as m from rates),
levels as (
  select source, m, rate / m as mean, 0 as k, exp(-(rate / m)) as term, exp(-(rate / m)) as level from parts
  union all
  select source, m, mean, k + 1, term * mean / (k + 1), level + term * mean / (k + 1)
  from levels where k < {mixing.PART_TERMS}),
tables as (select source, m, list(level) as all_levels from levels group by source, m),
draws as (
  select d.doc_id, d.source, t.all_levels,
    unnest(list_transform(range(1, t.m + 1), lambda j:
      cast('0x' || substr(md5('7:' || d.doc_id::varchar || ':' || j::varchar), 1, 13) as bigint)
      / {mixing.DRAW_STEPS})) as u
  from documents d join tables t on d.source is not distinct from t.source),
copies as (
  select doc_id, sum(len(list_filter(all_levels, lambda x: x <= u)))::int as n from draws group by doc_id)
select d.*, unnest(range(1, c.n + 1))::int as mix_copy
from documents d join copies c using (doc_id) where c.n > 0"""


def _preference() -> str:
    return r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  where conv_id is not null and turn is not null),
heads as (
  select conv_id, arg_min(turn, md5(conv_id || ':' || turn)) as fork from turns where role = 'assistant'
  group by conv_id),
numbered as (
  select conv_id, fork,
    coalesce(lead(conv_id) over (order by conv_id), lag(conv_id) over (order by conv_id)) as other from heads),
sides as (
  select conv_id as pair_id, turn, 'chosen' as side, role, text from turns
  union all
  select t.conv_id, t.turn, 'rejected', t.role, t.text from turns t left join heads h using (conv_id)
  where h.fork is null or t.turn < h.fork
  union all
  select n.conv_id, t.turn - o.fork + n.fork, 'rejected', t.role, t.text
  from numbered n join heads o on o.conv_id = n.other join turns t on t.conv_id = n.other and t.turn >= o.fork),
said as (
  select * from sides qualify row_number() over (partition by pair_id, turn, side order by role, text) = 1),
both_sides as (
  select pair_id, turn, max(role) filter (side = 'chosen') as c_role, max(text) filter (side = 'chosen') as c_text,
    max(role) filter (side = 'rejected') as r_role, max(text) filter (side = 'rejected') as r_text
  from said group by pair_id, turn),
forks as (
  select pair_id, min(turn) filter (c_role is distinct from r_role or c_text is distinct from r_text) as fork
  from both_sides group by pair_id having count(c_role) > 0 and count(r_role) > 0),
placed as (select * from both_sides join forks using (pair_id)),
parts as (
  select pair_id, 'prompt' as part, turn, c_role as role, c_text as body, false as trained from placed
  where fork is null or turn < fork
  union all
  select pair_id, 'chosen', turn, c_role, c_text, c_role = 'assistant' from placed
  where turn >= fork and c_role is not null
  union all
  select pair_id, 'rejected', turn, r_role, r_text, r_role = 'assistant' from placed
  where turn >= fork and r_role is not null)
select pair_id, part, turn, role, '<|' || role || '|>' || chr(10) || body || '<|end|>' || chr(10) as text,
  case when trained then length(role) + 5 else 0 end::bigint as mask_start,
  case when trained then length(role) + length(body) + 13 else 0 end::bigint as mask_end
from parts"""


_CRC_TABLE = """
crc as (
  select list(c order by i) as t from (
    select i, list_reduce([i] || range(8), lambda c, k:
      case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as c
    from range(256) as steps(i)))"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of ``text``, with the table ``t`` of ``crc``."""
    octets = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda x: ('0x' || x)::bigint)"
    return (f"xor(list_reduce([4294967295::bigint] || {octets}, "
            "lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::bigint)")


def _byte_shards() -> str:
    return f"""
with {_CRC_TABLE},
sized as (
  select doc_id, coalesce(strlen(text), 0)::bigint + 1 as size, {_crc32("coalesce(text, '')")} as text_crc32
  from documents cross join crc),
placed as (
  select *, sum(size) over (order by doc_id, text_crc32, size rows unbounded preceding) - size as before,
    sum(size) over () as total
  from sized),
cut as (select *, least(((2 * before + size) * 8) // (2 * total), 7)::int as shard from placed)
select doc_id, size, text_crc32, 'bytes' as law, shard,
  row_number() over (partition by shard order by doc_id, text_crc32, size) - 1 as slot, null::int as grown_shard
from cut"""


def _merkle() -> str:
    def leaf(text: str) -> str:
        fields = ["doc_id::varchar", "source", "lang", "n_chars::varchar", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({f})::varchar || ':' || {f}, '-')" for f in fields) + ")"

    def climb(name: str, leaves: str) -> str:
        return f"""{name} as (
  select grp, 0 as level, idx, n, node from {leaves}
  union all
  select grp, level + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(node, '' order by idx))
  from {name} where n > 1 group by grp, level, idx // 3)"""

    def siblings(tree: str, leaves: str, key: str) -> str:
        return f"""
  select l.{key}, t.level, coalesce(string_agg(t.node, '' order by t.idx) filter (t.idx < l.idx // (3 ** t.level)::bigint), '') as before,
    coalesce(string_agg(t.node, '' order by t.idx) filter (t.idx > l.idx // (3 ** t.level)::bigint), '') as after
  from {leaves} l join {tree} t on t.grp = l.grp and t.n > 1 and t.idx // 3 = l.idx // (3 ** (t.level + 1))::bigint
  group by l.{key}, t.level"""

    return f"""
with recursive {_CRC_TABLE},
hashed as (
  select doc_id, coalesce('s' || source, '-') as grp, {leaf("text")} as node,
    case when {_crc32("doc_id::varchar")} % 2 = 0 then {leaf("replace(text, chr(10), '')")} else {leaf("text")} end as changed
  from documents cross join crc),
leaves as (
  select *, row_number() over (partition by grp order by doc_id) - 1 as idx, count(*) over (partition by grp) as n
  from hashed),
{climb("tree", "leaves")},
sources as (
  select '' as grp, grp as source, row_number() over (order by grp) - 1 as idx, count(*) over () as n, node
  from tree where n = 1),
{climb("upper_tree", "sources")},
runs as (
  select doc_id, level, before, after from ({siblings("tree", "leaves", "doc_id")})
  union all
  select l.doc_id, 1000 + level, before, after
  from ({siblings("upper_tree", "sources", "source")}) s join leaves l on l.grp = s.source),
steps as (select *, row_number() over (partition by doc_id order by level) as step from runs),
folds as (
  select doc_id, 0::bigint as step, changed as node from leaves
  union all
  select f.doc_id, s.step, sha256(s.before || f.node || s.after)
  from folds f join steps s on s.doc_id = f.doc_id and s.step = f.step + 1),
proofs as (select doc_id, string_agg(before || after, '' order by step) as proof from steps group by doc_id),
done as (
  select l.doc_id, l.node as leaf, s.node as subroot, (select node from upper_tree where n = 1) as root,
    sha256(coalesce(p.proof, '')) as proof_sha256,
    (select arg_max(f.node, f.step) from folds f where f.doc_id = l.doc_id) as folded_root
  from leaves l join sources s on s.source = l.grp left join proofs p using (doc_id))
select *, folded_root = root as verified from done"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _quality(), "op2_mix_sources": _mixing(),
            "op5_preference_turns": _preference(), "op11_merkle_manifest": _merkle(),
            "op12_byte_shards": _byte_shards()}
