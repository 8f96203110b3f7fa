"""DuckDB SQL of the catalogue's queries, written apart from the Spark plans."""

from __future__ import annotations

from siftlane.plans.derived import CIGAR, FLAG, SIDES

NAME = "'F' || lpad(cast({} as varchar), 9, '0')"
SUMS = "coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[{}]', 1), lambda x: cast(x as bigint))), 0)::bigint"


def aln(side: str) -> str:
    where, nm, choice = SIDES[side]
    return f"""select {NAME.format('l_orderkey')} qname, cast({FLAG} as int) flag, case when l_linenumber = 5 then -1 else cast(l_suppkey % 3 as int) end ref_id,
        cast(l_partkey * 10 as bigint) pos, cast({nm} as bigint) nm, {CIGAR.format(choice)} cigar, cast(l_suppkey % 61 as int) mapq,
        l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice from lineitem where {where}"""


PRIMARY = "(flag & 2308) = 0 and ref_id >= 0"
WITH = f"""with graft as ({aln('graft')}), host as ({aln('host')}),
sides as (select 'graft' side, * from graft union all select 'host', * from host),
prim as (select side, qname, flag, nm + {SUMS.format('IS')} score from sides where {PRIMARY}),
frag as (select qname,
    count(*) filter (side = 'graft') n_g, count(*) filter (side = 'host') n_h,
    count(*) filter (side = 'graft' and (flag & 192) = 64) first_g, count(*) filter (side = 'graft' and (flag & 192) = 128) second_g,
    count(*) filter (side = 'host' and (flag & 192) = 64) first_h, count(*) filter (side = 'host' and (flag & 192) = 128) second_h,
    count(*) filter (side = 'graft' and not ((flag & 1) = 1 and (flag & 192) in (64, 128))) odd_g,
    count(*) filter (side = 'host' and not ((flag & 1) = 1 and (flag & 192) in (64, 128))) odd_h,
    max(score) filter (side = 'graft' and (flag & 192) = 64) g1, max(score) filter (side = 'graft' and (flag & 192) = 128) g2,
    max(score) filter (side = 'host' and (flag & 192) = 64) h1, max(score) filter (side = 'host' and (flag & 192) = 128) h2
  from prim group by qname),
amb as (select *, odd_g > 0 or first_g > 1 or second_g > 1 ambiguous_g, odd_h > 0 or first_h > 1 or second_h > 1 ambiguous_h from frag)
"""


def reason(t: str = "4", p: str = "8", better: str = "total") -> str:
    g1, g2, h1, h2 = (f"(case when {m}_{x} = 0 then {p} else {x}{k} end)" for x in "gh" for k, m in ((1, "first"), (2, "second")))
    return f"""case when ambiguous_g or ambiguous_h then 'discarded_ambiguous' when n_g = 0 and n_h > 0 then 'host_graft_absent' when n_g = 0 then 'discarded_absent'
        when n_h = 0 and ({g1} < {t} or {g2} < {t}) then 'graft_host_absent_any_mate_below_threshold' when n_h = 0 then 'discarded_host_absent_both_mates_at_or_above_threshold'
        when {g1} >= {t} or {g2} >= {t} then 'discarded_threshold' when {g1} + {g2} < {h1} + {h2} then 'graft_better_{better}' when {g1} + {g2} > {h1} + {h2} then 'host_better_{better}' else 'discarded_tie' end"""


def cls(column: str = "reason") -> str:
    return f"case when {column} like 'graft%' then 'graft' when {column} like 'host%' then 'host' else 'discarded' end"


WITH += f", done as (select *, {reason()} reason, {cls(reason())} classification from amb)\n"
LEGACY = f", legacy as (select qname from (select qname, {reason('3')} r from amb) where r like 'graft%' union all select 'N' || n_nationkey from nation), modern as (select qname from done where classification = 'graft'), original as (select distinct qname from frag where n_g > 0)\n"
TRUTH = "case when cast(substr(qname, 2) as bigint) % 3 = 0 then 'mouse' else 'human' end"
PROFILE = """count(*) total_records, count(*) filter ((flag & 1) > 0) paired_records, count(*) filter ((flag & 4) > 0) unmapped_records, count(*) filter ((flag & 256) > 0) secondary_records,
    count(*) filter ((flag & 2048) > 0) supplementary_records, count(*) filter ((flag & 2308) = 0) mapped_primary_records, count(*) filter ((flag & 2308) = 0 and (flag & 192) = 64) first_mate_primary_records,
    count(*) filter ((flag & 2308) = 0 and (flag & 192) = 128) second_mate_primary_records, count(*) filter ((flag & 2308) = 0 and (flag & 192) in (0, 192)) invalid_primary_mate_records"""
SHAPE = """case when mapped_primary_records = 0 then 'none' when invalid_primary_mate_records > 0 then 'invalid_mate_flag' when first_mate_primary_records > 1 or second_mate_primary_records > 1 then 'duplicate_primary_mate'
    when first_mate_primary_records = 1 and second_mate_primary_records = 1 then 'complete_pair' when first_mate_primary_records = 1 then 'first_mate_only' when second_mate_primary_records = 1 then 'second_mate_only' else 'unpaired_primary' end"""


def shapes(table: str) -> str:
    return f"(select qname, mapped_primary_records p, {SHAPE} category from (select qname, {PROFILE} from {table} group by qname))"


CROSSTAB = f"""{WITH}{LEGACY}, mod_rec as (select * from graft where {PRIMARY} and qname in (select qname from modern)), leg_rec as (select * from graft where {PRIMARY} and qname in (select qname from legacy)),
s as (select o.qname, coalesce(a.category, 'none') og, coalesce(b.category, 'none') oh, coalesce(c.category, 'none') mf, coalesce(e.category, 'none') lf from original o
  left join {shapes('graft')} a using (qname) left join {shapes('host')} b using (qname) left join {shapes('mod_rec')} c using (qname) left join {shapes('leg_rec')} e using (qname))
select counter, value, count(*) n from (select 'original_graft' counter, og value from s union all select 'original_host', oh from s union all select 'modern_filtered', mf from s union all select 'legacy_filtered', lf from s
  union all select 'joint_original_alignment_shape', 'graft=' || og || ';host=' || oh from s union all select 'output_membership', 'modern=' || mf || ';legacy=' || lf from s) group by all"""


def rates(source: str) -> str:
    """Metrics of rows with tp, fn, fp, tn."""
    r = lambda a, b: f"case when {b} = 0 then null else cast({a} as double) / cast({b} as double) end"
    return f"""select *, (sensitivity + specificity) / 2 balanced_accuracy, case when precision + sensitivity <> 0 then 2 * precision * sensitivity / (precision + sensitivity) end f1 from (
      select *, {r('(tp + tn)', '(tp + fn + fp + tn)')} accuracy, {r('tp', '(tp + fn)')} sensitivity, {r('tn', '(tn + fp)')} specificity, {r('tp', '(tp + fp)')} "precision", {r('tn', '(tn + fn)')} npv, {r('fp', '(tn + fp)')} fpr, {r('fn', '(tp + fn)')} fnr from ({source}))"""


FOUR = "count(*) filter (own and hit) tp, count(*) filter (own and not hit) fn, count(*) filter (not own and hit) fp, count(*) filter (not own and not hit) tn"
CONFUSION = f"select {FOUR} from (select {TRUTH} = 'human' own, classification = 'graft' hit from done)"


def grid(*by: str) -> str:
    more = "".join(f", {b}" for b in by)
    return f"""select 't' || t || '-p' || p "label", t, p{more}, {FOUR} from (select t, p, {TRUTH} = 'human' own, {reason('t', 'p')} like 'graft%' hit, cast(cast(substr(qname, 2) as bigint) % 5 as int) replicate
      from amb, (values (3), (4), (5), (6)) a(t), (values (8), (10), (12)) b(p)) group by t, p{more}"""


def reads(base: str = "T") -> str:
    return f"""select *, substr(s0, 1, m - 1) || '{base}' || substr(s0, m + 1) seq from (select *, case l_suppkey % 7 when 0 then 'N' || substr(win, 1, 49) when 1 then substr(win, 1, 20) || 'G' || substr(win, 21, 29)
        when 2 then substr(win, 1, 30) || substr(win, 33, 20) else substr(win, 1, 50) end s0 from (select l_partkey, l_suppkey, substr(repeat('ACGTTGCACCGGATTA', 6), cast(1 + l_partkey % 16 as int), 60) win,
        {CIGAR.format('l_suppkey % 7')} cigar, cast(1 + l_suppkey % 45 as int) m, case when l_partkey % 10 = 0 then null when l_suppkey % 3 = 0 then 'GA' else 'CT' end xg, cast(16 * (l_suppkey % 2) as int) flag
        from (select distinct l_partkey, l_suppkey from lineitem)))"""


CONV = "coalesce(xg, case when (flag & 16) > 0 then 'GA' else 'CT' end)"


def nm(source: str, key: str = "l_partkey, l_suppkey") -> str:
    """key, plain and free (of conversions) distances of the reads, by cumulative sums over their operations."""
    return f"""select {key}, sum(case when op in ('I', 'D') then n else bad end)::bigint plain, sum(case when op in ('I', 'D') then n else worse end)::bigint free from (
      select *, case when op in ('M', '=', 'X') then len(list_filter(range(n), lambda i: substr(seq, cast(rp + i + 1 as int), 1) <> substr(win, cast(fp + i + 1 as int), 1))) else 0 end bad,
        case when op in ('M', '=', 'X') then len(list_filter(range(n), lambda i: substr(seq, cast(rp + i + 1 as int), 1) <> substr(win, cast(fp + i + 1 as int), 1)
          and not (conv = 'CT' and substr(win, cast(fp + i + 1 as int), 1) = 'C' and substr(seq, cast(rp + i + 1 as int), 1) = 'T')
          and not (conv = 'GA' and substr(win, cast(fp + i + 1 as int), 1) = 'G' and substr(seq, cast(rp + i + 1 as int), 1) = 'A'))) else 0 end worse
      from (select *, coalesce(sum(case when op in ('M', '=', 'X', 'I', 'S') then n else 0 end) over w, 0) rp, coalesce(sum(case when op in ('M', '=', 'X', 'D', 'N') then n else 0 end) over w, 0) fp
        from (select {key}, seq, win, {CONV} conv, unnest(regexp_extract_all(cigar, '([0-9]+)[MIDNSHP=X]', 1))::bigint n, unnest(regexp_extract_all(cigar, '[0-9]+([MIDNSHP=X])', 1)) op, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), 1) k from ({source}))
        window w as (partition by {key} order by k rows between unbounded preceding and 1 preceding))) group by {key}"""


ROWS = f"""select l_partkey * 1000 + l_suppkey ordinal, {NAME.format('l_partkey')} qname, flag, 'chr' || (l_suppkey % 3 + 1) reference, cast(l_partkey * 10 as bigint) pos, cigar,
    case when l_partkey % 7 = 0 then -1 else l_partkey % 6 end stored_nm, {SUMS.format('I')} i, {SUMS.format('S')} s, plain, free from ({reads()}) join ({nm(reads())}) using (l_partkey, l_suppkey)"""
COMPARED = f"""with r as ({ROWS}), o as (select ordinal, qname, flag, reference, pos, cigar, plain conventional_nm, free bisulfite_nm, i insertions, s soft_clips, free + i + s score from r),
a as (select ordinal, qname, flag + case when ordinal % 101 = 0 then 16 else 0 end flag, reference, pos, cigar, free + case when ordinal % 97 = 0 then 1 else 0 end nm, i + case when ordinal % 89 = 0 then 1 else 0 end insertions, s soft_clips, free + i + s + case when ordinal % 83 = 0 then 2 else 0 end score from r)
"""
IDENT = "qname, flag, ref_id, pos, cigar"
ORDER = "l_extendedprice, l_quantity, l_partkey, l_suppkey, l_linenumber"
OCCUR = f"""{WITH}, l as (select *, row_number() over (partition by {IDENT} order by {ORDER}) - 1 occurrence from graft),
r as (select {IDENT}, cast(l_partkey % 4 as bigint) stored_nm, row_number() over (partition by {IDENT} order by {ORDER}) - 1 occurrence from graft where l_quantity > 10),
j as (select l.*, r.stored_nm, r.qname is not null matched from l left join r using ({IDENT}, occurrence))
"""
SINGLE = f"""with g as (select {NAME.format('o_orderkey')} qname, cast(o_custkey % 7 as bigint) s from orders where o_orderkey % 6 <> 0), h as (select {NAME.format('o_orderkey')} qname, cast((o_orderkey + o_custkey) % 5 as bigint) s from orders where o_orderkey % 6 <> 1),
f as (select qname, count(g.s) n_g, count(h.s) n_h, max(g.s) sg, max(h.s) sh from g full outer join h using (qname) group by qname),
k as (select case when n_g > 1 or n_h > 1 then 'discarded_ambiguous' when n_g = 0 then 'host_graft_absent' when sg >= 4 then 'discarded_threshold' when n_h = 0 then 'graft_host_absent' when sg < sh then 'graft_better' when sg > sh then 'host_better' else 'discarded_tie' end reason from f)
select reason, {cls()} classification, count(*) n from k group by all"""
METRICS25 = f"select label cell, unnest(['sensitivity', 'specificity', 'precision']) metric, unnest([sensitivity, specificity, \"precision\"]) v from ({rates(grid())})"

SAMPLED = f"""{WITH}{LEGACY}, mod_rec as (select * from graft where {PRIMARY} and qname in (select qname from modern)), leg_rec as (select * from graft where {PRIMARY} and qname in (select qname from legacy)),
s as (select qname from original where qname in (select qname from modern) and qname not in (select qname from legacy) order by sha256('seed:' || qname), qname limit 50)
select qname fragment_id, coalesce(a.category, 'none') original_graft_category, coalesce(b.category, 'none') original_host_category, coalesce(c.category, 'none') modern_filtered_category, coalesce(e.category, 'none') legacy_filtered_category,
  coalesce(a.p, 0) original_graft_primary_records, coalesce(b.p, 0) original_host_primary_records, coalesce(c.p, 0) modern_filtered_primary_records, coalesce(e.p, 0) legacy_filtered_primary_records
from s left join {shapes('graft')} a using (qname) left join {shapes('host')} b using (qname) left join {shapes('mod_rec')} c using (qname) left join {shapes('leg_rec')} e using (qname)"""
ERRORS = f"""with r as (select l_partkey * 1000 + l_suppkey ordinal, (l_partkey * 1000 + l_suppkey) % 13 k, cast(l_partkey * 10 as bigint) p, l_suppkey % 3 ref, flag f, win w, substr(seq || repeat('A', 50), 1, 50) q from ({reads()})),
b as (select ordinal, case k when 0 then '*' when 1 then 'M50' when 2 then '20M5B25M' when 3 then '0M50M' when 4 then '50S' when 9 then '51M' when 11 then '49M' else '50M' end cigar, case k when 5 then null when 10 then substr(w, 1, 10) else w end win,
  case when k = 6 then -1 else ref end ref, case when k = 7 then -1 else p end pos, case when k = 8 then '' else q end seq, f from r),
c as (select *, {SUMS.format('MDN=X')} span, {SUMS.format('MIS=X')} used from b)
select ordinal, case when cigar in ('*', '') then 'empty_cigar' when not regexp_full_match(cigar, '([0-9]+[A-Z=])+') then 'invalid_cigar' when not regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+') then 'unsupported_operation'
  when regexp_matches(cigar, '(^|[A-Z=])0+[A-Z=]') then 'invalid_length' when span = 0 then 'no_reference_bases' when win is null then 'reference_not_found' when ref < 0 or (f & 4) > 0 then 'unmapped' when pos < 0 then 'negative_position'
  when length(seq) = 0 then 'empty_sequence' when used > length(seq) then 'beyond_read' when span > length(win) then 'beyond_reference' when used <> length(seq) then 'unused_bases' end error from c"""


def windowed(side: str) -> str:
    where, _, choice = SIDES[side]
    return f"""select id, side, qname, flag, ref_id, cigar, win, xg, substr(s0, 1, m - 1) || 'T' || substr(s0, m + 1, m2 - m - 1) || 'A' || substr(s0, m2 + 1) seq from (
      select *, case choice when 0 then 'N' || substr(win, 1, 49) when 1 then substr(win, 1, 20) || 'G' || substr(win, 21, 29) when 2 then substr(win, 1, 30) || substr(win, 33, 20) else substr(win, 1, 50) end s0 from (
        select l_orderkey * 10 + l_linenumber id, '{side}' side, {NAME.format('l_orderkey')} qname, cast({FLAG} as int) flag, case when l_linenumber = 5 then -1 else cast(l_suppkey % 3 as int) end ref_id, {CIGAR.format(choice)} cigar, {choice} choice,
          substr(repeat('ACGTTGCACCGGATTA', 6), cast(1 + l_partkey % 16 as int), 60) win, cast(2 + l_suppkey % 20 as int) m, cast(24 + l_partkey % 20 as int) m2, case when l_partkey % 10 = 0 then null when l_suppkey % 3 = 0 then 'GA' else 'CT' end xg from lineitem where {where}))"""


def rescored(kind: str, where: str = "true") -> str:
    """Fragments' sums with scores computed against the reference; ends in amb."""
    both = " union all ".join(f"select * from ({windowed(side)}) where {PRIMARY} and {where}" for side in SIDES)
    frag = WITH[WITH.index("frag as ("):WITH.index(", done as")]
    return f"with w as ({both}), found as ({nm('select * from w', 'id, side')}), prim as (select side, qname, flag, {kind} + {SUMS.format('IS')} score from w join found using (id, side)), {frag}"


SINGLE_REASON = """case when n_g > 1 or n_h > 1 then 'discarded_ambiguous' when n_g = 0 then 'host_graft_absent' when g1 >= 4 then 'discarded_threshold' when n_h = 0 then 'graft_host_absent' when g1 < h1 then 'graft_better' when g1 > h1 then 'host_better' else 'discarded_tie' end"""
EVIDENCE = f"""{COMPARED}, o2 as (select *, row_number() over (partition by qname, flag, reference, pos, cigar order by ordinal) k from o), t as (select qname, flag, reference, pos, cigar, conventional_nm v, row_number() over (partition by qname, flag, reference, pos, cigar order by ordinal) k from o where ordinal % 11 <> 0),
b as (select o2.*, t.v from o2 left join t on (o2.qname, o2.flag, o2.reference, o2.pos, o2.cigar, o2.k) = (t.qname, t.flag, t.reference, t.pos, t.cigar, t.k))"""
METRICS = ("accuracy", "sensitivity", "specificity", "precision", "npv", "fpr", "fnr", "balanced_accuracy", "f1")


def same(a: str, b: str, name: str) -> str:
    return f"select count(*) filter (x and y) in_both, count(*) filter (x and not y) only_in_first, count(*) filter (y and not x) only_in_second, bool_and(x = y) equal, '{name}' \"between\" from (select {a} like 'graft%' x, {b} like 'graft%' y from amb)"


SQL: dict[str, str] = {
    "q01_primary_mapped": f"{WITH} select side, ref_id, count(*) n from sides where {PRIMARY} group by all",
    "q02_cigar_sums": f"{WITH} select cigar, {SUMS.format('I')} insertions, {SUMS.format('S')} soft_clips, count(*) n from sides group by all",
    "q03_plain_score": f"{WITH} select side, score, count(*) n from prim group by all",
    "q04_reference_span": f"{WITH} select side, {SUMS.format('MDN=X')} ref_span, {SUMS.format('MIS=X')} read_span, count(*) n from sides group by all",
    "q05_cigar_ops_explode": f"{WITH} select side, place, op, count(*) n, sum(x)::bigint total_len from (select side, unnest(regexp_extract_all(cigar, '[0-9]+([A-Z=])', 1)) op, unnest(regexp_extract_all(cigar, '([0-9]+)[A-Z=]', 1))::bigint x, cast(generate_subscripts(regexp_extract_all(cigar, '[0-9]+[A-Z=]'), 1) - 1 as int) place from sides) group by all",
    "q06_pair_build": f"{WITH} select qname, n_g, first_g, second_g, n_h, first_h, second_h, ambiguous_g, ambiguous_h from amb",
    "q07_fragment_universe": f"{WITH} select case when n_h = 0 then 'graft_only' when n_g = 0 then 'host_only' else 'both' end presence, count(*) n from frag group by all",
    "q08_paired_classify": f"{WITH} select qname, reason, classification from done",
    "q09_paired_reason_counts": f"{WITH} select reason, count(*) n from done group by all",
    "q10_single_classify": SINGLE,
    "q11_sample_summary": f"{WITH}, c as (select count(*) total, count(*) filter (n_g > 0 and n_h = 0) graft_only, count(*) filter (n_g = 0 and n_h > 0) host_only, count(*) filter (n_g > 0 and n_h > 0) both_sides, count(*) filter (classification = 'graft') graft, count(*) filter (classification = 'host') host, count(*) filter (classification = 'discarded') discarded from done) select 'sample' sample_id, *, cast(graft as double) / total * 100 graft_percent, cast(host as double) / total * 100 host_percent, cast(discarded as double) / total * 100 discarded_percent, cast(graft as double) / total * 100 total_graft_percent, both_sides > 0 overlap_found from c",
    "q12_selected_records": f"{WITH} select qname, flag, ref_id, pos, nm, cigar from graft where {PRIMARY} and qname in (select qname from done where classification = 'graft')",
    "q13_mode_validation": "select * from (values ('paired', 'paired-end', 'paired-end', null), ('single', 'single-end', 'single-end', null), ('crossed', 'paired-end', 'single-end', 'graft_and_host_differ')) v(sample_id, graft_mode, host_mode, mode_error)",
    "q14_allowlist_semi": f"{WITH} select side, qname, count(*) n from sides where qname in (select {NAME.format('o_orderkey')} from orders where o_orderkey % 50 = 0) group by all",
    "q15_score_audit": f"with r as ({ROWS}) select ordinal record_ordinal, qname || '\\t' qname, flag, reference, pos position_0_based, cigar, stored_nm::bigint stored_nm, plain nm, i insertions, s soft_clips, plain + i + s classification_score from r",
    "q16_membership_counts": f"{WITH}{LEGACY}, m as (select qname, case when qname in (select qname from modern) then 'graft' else 'discarded' end a, case when qname in (select qname from legacy) then 'graft' else 'discarded' end b from original) select a || '/' || b category, count(*) n from m group by all union all select 'modern_selected_not_in_original', count(*) from (select distinct qname from modern) where qname not in (select qname from original) union all select 'legacy_selected_not_in_original', count(*) from (select distinct qname from legacy) where qname not in (select qname from original)",
    "q17_name_digest": f"{WITH} select substr(qname, 1, 8) prefix, count(*) n, sha256(string_agg(qname, chr(10) order by qname) || chr(10)) sha256 from (select distinct qname from prim where side = 'graft') group by all",
    "q18_alignment_profile": f"{WITH} select *, {SHAPE} category from (select side, qname, {PROFILE} from sides group by all)",
    "q18b_alignment_categories": f"{WITH} select side, {SHAPE} category, count(*) n from (select side, qname, {PROFILE} from sides group by all) group by all",
    "q18c_shape_crosstabs": CROSSTAB,
    "q19_decision_pairs": f"{WITH} select 'modern=' || {reason()} || ';legacy=' || {reason('3', '8', 'mean')} decision_pair, count(*) n from amb where not ambiguous_g and not ambiguous_h and n_g > 0 group by all",
    "q20_host_absent_transitions": f"{WITH} select 'modern_scores=' || (case when first_g = 0 then 8 else g1 end) || ',' || (case when second_g = 0 then 8 else g2 end) || ';legacy_scores=' || (case when first_g = 0 then 10 else g1 end) || ',' || (case when second_g = 0 then 10 else g2 end) transition, count(*) n from amb where not ambiguous_g and not ambiguous_h and n_g > 0 and n_h = 0 group by all",
    "q21_confusion": f"{WITH} {CONFUSION}",
    "q22_metrics": f"{WITH} {rates(CONFUSION)}",
    "q23_parameter_grid": f"{WITH} {rates(grid())}",
    "q24_grid_recommend": f"{WITH} select label, t, p, f1 from ({rates(grid())}) order by f1 desc nulls last, label limit 1",
    "q25_gradient_status": f"{WITH}, o as ({METRICS25}), x as (select cell, metric, round(v * 100, 4) observed, case when metric = 'precision' and cell like '%p12' then null else cast(cast(round(v * 100, 4) + (length(metric) % 4 - 1) * 0.9 as decimal(12, 4)) as double) end expected from o), y as (select *, round(observed - expected, 4) deviation from x) select *, case when abs(deviation) > 2.0 then 'large_deviation' when abs(deviation) > 0.5 then 'deviation' when deviation is not null then 'within_range' end status from y",
    "q26_occurrence_join": f"{OCCUR} select {IDENT}, occurrence, nm, stored_nm, matched from j",
    "q27_positional_compare": f"{COMPARED}, e as (select min(ordinal) e from o where ordinal not in (select ordinal from a)), b as (select o.*, a.ordinal is null gone, a.qname aq, a.flag af, a.nm, a.insertions ai, a.score asc_ from o left join a using (ordinal), e where e.e is null or o.ordinal <= e.e), c as (select ordinal, 'record_count' category from b where gone union all select ordinal, 'identity:flag' from b where not gone and flag <> af union all select ordinal, case when bisulfite_nm <> nm then 'score:bisulfite_nm' else 'score:insertions' end from b where not gone and (bisulfite_nm <> nm or insertions <> ai) union all select ordinal, 'score:classification_score' from b where not gone and score <> asc_) select category, count(*) n, min(ordinal)::bigint first_row from c group by all",
    "q28_delta_histogram": f"{OCCUR} select 'tool' \"label\", delta, count(*) n from (select 'vs_conventional:' || (stored_nm - nm) delta from j where matched union all select 'vs_half:' || (stored_nm - nm // 2) from j where matched) group by all",
    "q29_replicate_mean_sd": f"{WITH} select t, count(*) n, round(avg(sensitivity), 9) sensitivity_mean, round(stddev_samp(sensitivity), 9) sensitivity_sd, round(avg(f1), 9) f1_mean, round(stddev_samp(f1), 9) f1_sd from ({rates(grid('replicate'))}) where p = 8 group by t",
    "q30_mapping_decomposition": f"{WITH}, q as (select qname, max(mapq) mapq from graft where {PRIMARY} group by qname), d as (select {TRUTH} known_source, case when ambiguous_g then 'ambiguous' when n_g = 0 then 'none' when first_g = 1 and second_g = 1 then 'both_mates' when first_g = 1 then 'first_mate' else 'second_mate' end mates, classification = 'graft' selected, mapq from done left join q using (qname)) select known_source, mates, count(*) fragments, count(*) filter (selected) selected_n, count(*) filter (not selected) not_selected, cast(count(*) filter (selected) as double) / count(*) selection_rate, avg(mapq) mapq_mean, cast(median(mapq) as double) mapq_median from d group by all",
    "q31_nm_recalculate": f"select l_partkey, l_suppkey, plain nm from ({nm(reads())})",
    "q32_bisulfite_nm": " union all ".join(f"select '{b}' base, l_partkey, l_suppkey, {CONV} conversion, free nm from ({reads(b)}) join ({nm(reads(b))}) using (l_partkey, l_suppkey)" for b in "TA"),
    "q33_base_convert": "select p_partkey, case when l like '>%' then l else replace(upper(l), 'C', 'T') end ct, case when l like '>%' then l else replace(upper(l), 'G', 'A') end ga from (select p_partkey, case when p_partkey % 10 = 0 then '>' || p_name else 'acgtNnCG' || p_name end l from part)",
    "q34_xg_split": f"select xg, cigar, count(*) n from ({reads()}) where xg is not null group by all",
    "q35_chr_fallback": "with have as (select case when n_nationkey % 2 = 0 then 'chr' || n_nationkey else cast(n_nationkey as varchar) end contig, n_name held from nation), a as (select n_nationkey, case when n_nationkey % 3 = 0 then 'chr' || n_nationkey else cast(n_nationkey as varchar) end asked from nation), b as (select * from a union all select n_nationkey + 100, 'x' || asked from a) select n_nationkey, asked, coalesce((select held from have where contig = asked), (select held from have where contig = case when asked like 'chr%' then substr(asked, 4) else 'chr' || asked end)) held from b",
    "q36_hash_bottom_k": f"{WITH} select qname, sha256('seed:' || qname) sample_key from (select distinct qname from prim where side = 'graft') order by 2, 1 limit 100",
    "q37_record_counts": f"{WITH} select count(*) filtered_records, count(distinct qname) filtered_fragments from graft where {PRIMARY} and qname in (select qname from done where classification = 'graft')",
    "q38_unknown_selected": f"{WITH}{LEGACY} select distinct qname fragment_id from legacy where qname not in (select qname from frag)",
    "q39_window_fetch": "with t as (select 'chr' || (i // 20 + 1) contig, i % 20 k, substr(repeat('ACGTTGCACCGGATTA', 20), cast(1 + i % 16 as int), 256) seq from range(60) r(i)), g as (select contig, string_agg(seq, '' order by k) s from t group by contig), a as (select o_orderkey id, 'chr' || (o_custkey % 3 + 1) contig, o_orderkey % 5100 f, o_custkey % 600 + 1 n from orders) select id, case when f + n <= length(s) then substr(s, f + 1, n) end as window from a join g using (contig)",
    "q40_json_fields": "select event_id, coalesce(json_extract_string(props, '$.k'), '-') k, coalesce(json_extract_string(props, '$.k.none'), '-') as none from events",
    "q41_audit_categories": f"{COMPARED}, o2 as (select *, row_number() over (partition by qname, flag, reference, pos, cigar order by ordinal) k from o), t as (select qname, flag, reference, pos, cigar, conventional_nm v, row_number() over (partition by qname, flag, reference, pos, cigar order by ordinal) k from o where ordinal % 11 <> 0), b as (select o2.*, a.ordinal is null gone, a.flag af, a.nm, t.v from o2 left join a using (ordinal) left join t on (o2.qname, o2.flag, o2.reference, o2.pos, o2.cigar, o2.k) = (t.qname, t.flag, t.reference, t.pos, t.cigar, t.k)), c as (select 'audit_record_missing' category from b where gone union all select 'audit_oracle_identity:flag' from b where not gone and flag <> af union all select 'audit_vs_oracle_selected_nm' from b where not gone and nm <> bisulfite_nm union all select 'tool:missing' from b where v is null union all select 'tool:vs_oracle_conventional_nm' from b where not gone and v <> conventional_nm union all select 'tool:vs_oracle_bisulfite_nm' from b where not gone and v <> bisulfite_nm union all select 'tool:vs_audit_nm' from b where not gone and v <> nm) select category, count(*) n from c group by all",
    "q17b_global_digest": f"{WITH} select count(*) n, sha256(string_agg(qname, chr(10) order by qname) || chr(10)) sha256 from (select distinct qname from prim where side = 'graft')",
    "q43_disagreement_sample": SAMPLED,
    "q44_score_errors": ERRORS,
    "q45_tag_errors": f"{WITH} select error, count(*) n, sum(v)::bigint total from (select case l_partkey % 4 when 0 then 'missing_nm' when 1 then 'non_integer_nm' end error, case when l_partkey % 4 <> 0 then nm end v from graft) group by all",
    "q46_memory_sizes": "select o_orderkey, asked, case when bytes >= 8388608 then bytes end bytes from (select *, case when regexp_full_match(trim(asked), '[0-9]+ ?([KMGTkmgt]?)[Bb]?') then regexp_extract(asked, '^([0-9]+)', 1)::bigint * case upper(regexp_extract(asked, '([KMGTkmgt]?)[Bb]?$', 1)) when 'K' then 1024 when 'M' then 1048576 when 'G' then 1073741824 when 'T' then 1099511627776 else 1 end end bytes from (select o_orderkey, (o_orderkey % 3000)::varchar || (['', 'K', 'M', 'g', 'T', 'X', 'kb', ' MB'])[o_custkey % 8 + 1] asked from orders))",
    "q47_reference_names": f"{WITH} select ref_id, case when ref_id in (0, 1) then 'chr' || (ref_id + 1) end ref_name, case when ref_id not in (0, 1) then 'unknown_reference' end error, count(*) n from graft group by all",
    "q48_paired_recomputed": f"{rescored('plain')} select reason, {cls()} classification, null::varchar error, count(*) n from (select {reason()} reason from amb) group by all",
    "q49_single_bisulfite": f"{rescored('free', '(flag & 192) = 64')} select reason, {cls()} classification, null::varchar error, count(*) n from (select {SINGLE_REASON} reason from amb) group by all",
    "q50_unknown_cells": f"{WITH} select label cell from ({grid()}) where label like 't6%'",
    "q51_tool_counts": f"{EVIDENCE} select 'tool' tool, count(*) expected, count(v) observed, count(*) filter (v = conventional_nm) conventional_nm_equal, count(*) filter (v = bisulfite_nm) bisulfite_nm_equal, count(*) - count(v) missing, count(*) = count(v) identity_equals_original from b",
    "q52_tool_deltas": f"{EVIDENCE} select 'tool' tool, delta, count(*) n from (select unnest(['vs_oracle_conventional:' || (v - conventional_nm), 'vs_oracle_bisulfite:' || (v - bisulfite_nm)]) delta from b where v is not null) group by all",
    "q53_first_difference": f"{COMPARED}, d as (select o.ordinal row_number, case when o.flag <> a.flag then 'identity:flag' when bisulfite_nm <> nm then 'score:bisulfite_nm' when o.insertions <> a.insertions then 'score:insertions' when o.score <> a.score then 'score:classification_score' end category, o.qname, o.score expected, a.score found from o join a using (ordinal)) select * from d where category is not null order by row_number limit 1",
    "q54_same_selection": f"{WITH} {same(reason(), reason('3'), 'thresholds')} union all {same(reason(), reason('4', '12'), 'penalties')}",
    "q55_replicate_table": f"{WITH} select t, p, count(*) n, {', '.join(f'round(avg({chr(34)}{m}{chr(34)}), 9) {m}_mean, round(stddev_samp({chr(34)}{m}{chr(34)}), 9) {m}_sd' for m in METRICS)} from ({rates(grid('replicate'))}) group by t, p",
    "q56_identity_keys": f"{WITH} select to_json([qname, flag::varchar, ref_id::varchar, pos::varchar, cigar, (row_number() over (partition by {IDENT} order by {ORDER}) - 1)::varchar])::varchar identity_key, nm from graft",
}
SQL["q42_status_tally"] = f"with s as ({SQL['q25_gradient_status']}) select outcome, count(status) n from (values ('within_range'), ('deviation'), ('large_deviation')) v(outcome) left join s on status = outcome group by outcome"
