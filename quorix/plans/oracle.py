"""SQL that the scoring queries are held against, written apart from their plans."""

from __future__ import annotations

D, K, SAMPLE, ROUNDS = 14, 256, 131_072, 10
EMB = 64


def quant(x: str) -> str:
    return f"cast(trunc(cast(greatest(least({x}, cast(1 as float)), cast(-1 as float)) * cast(10000 as float) + cast(case when {x} >= 0 then 0.5 else -0.5 end as float) as float)) as integer)"


def dist(a: str, b: str, width: int, kind: str = "bigint") -> str:
    return " + ".join(f"(cast({a}[{j}] as {kind}) - cast({b}[{j}] as {kind})) * (cast({a}[{j}] as {kind}) - cast({b}[{j}] as {kind}))" for j in range(1, width + 1))


def bound(q: str, lo: str, hi: str, width: int) -> str:
    gap = lambda j: f"greatest(cast({lo}[{j}] as bigint) - {q}[{j}], cast({q}[{j}] as bigint) - {hi}[{j}], 0)"
    return " + ".join(f"{gap(j)} * {gap(j)}" for j in range(1, width + 1))


def clamp(x: str) -> str:
    return f"greatest(least({x}, cast(1 as float)), cast(0 as float))"


def share(x: str, most: float) -> str:
    return clamp(f"(cast({x} as float) / cast({most} as float))")


EMBEDDED = f"emb as (select vec_id as orig_id, list_transform(embedding, lambda x: {quant('x')}) as q, case when label < 3 then 1 else 0 end as label from embeddings)"

TX = """tx as (select e.event_id as tx_id, e.ts as requested_at, e.user_id as user_id,
 cast(e.value * 30 as float) as amount, cast(1 + e.event_id % 14 as float) as installments,
 cast(cu.c_acctbal / 10 as float) as customer_avg,
 cast(count(*) over (partition by e.user_id order by e.ts range between interval 24 hours preceding and current row) - 1 as float) as count_24h,
 e.event_id % 50 as merchant_no, e.event_id % 12 as mcc_no, cast(su.s_acctbal as float) as merchant_avg,
 e.event_type in ('view', 'click') as is_online, e.event_id % 3 = 0 as card_present,
 cast((e.event_id * 37) % 1500 + 0.25 as float) as km_home,
 lag(e.ts) over (partition by e.user_id order by e.ts, e.event_id) as last_ts,
 cast((e.event_id * 53) % 1200 as float) as km_last,
 case when e.event_type = 'error' or e.value > 40 then 1 else 0 end as fraud
from events e join customer cu on cu.c_custkey = e.user_id join supplier su on su.s_suppkey = e.event_id % 10)"""

RISK = "cast(case mcc_no when 0 then 0.15 when 1 then 0.30 when 2 then 0.20 when 3 then 0.45 when 4 then 0.80 when 5 then 0.75 when 6 then 0.85 when 7 then 0.35 when 8 then 0.25 else 0.5 end as float)"
UNKNOWN = "cast(case when merchant_no % 5 = user_id % 5 then 0 else 1 end as float)"
MINUTES = "abs(epoch_us(requested_at) // 1000000 - epoch_us(last_ts) // 1000000) // 60"
FEATURES = [
    share("amount", 10000), share("installments", 12),
    f"case when customer_avg > 0 then {clamp('(amount / customer_avg) / cast(10 as float)')} else cast(1 as float) end",
    share("hour(requested_at)", 23), share("isodow(requested_at) - 1", 6),
    f"case when last_ts is null then cast(-1 as float) else {share(MINUTES, 1440)} end",
    f"case when last_ts is null then cast(-1 as float) else {share('km_last', 1000)} end",
    share("km_home", 1000), share("count_24h", 20),
    "cast(case when is_online then 1 else 0 end as float)", "cast(case when card_present then 1 else 0 end as float)",
    UNKNOWN, RISK, share("merchant_avg", 10000),
]
FEAT = "feat as (select tx_id, fraud, " + ", ".join(f"{e} as f{i}" for i, e in enumerate(FEATURES)) + " from tx)"
QUANT = "vec as (select tx_id, fraud, [" + ", ".join(quant(f"f{i}") for i in range(D)) + "] as q from feat)"
SPLIT = "refs as (select row_number() over (order by tx_id) - 1 as orig_id, tx_id, q, fraud as label from vec), queries as (select tx_id as qid, q from vec where tx_id % 20 = 0)"
BASE = f"with {TX}, {FEAT}, {QUANT}, {SPLIT}"


def top5(queries: str, refs: str, width: int) -> str:
    return f"near as (select * from (select qid, orig_id, label, d, row_number() over (partition by qid order by d, orig_id) as rank from (select a.qid, b.orig_id, b.label, {dist('a.q', 'b.q', width)} as d from {queries} a, {refs} b)) where rank <= 5)"


VOTES = "votes as (select a.qid, cast(coalesce(sum(n.label), 0) as bigint) as frauds from queries a left join near n on n.qid = a.qid group by a.qid)"
BODY = "'{\"approved\":' || case when frauds < 3 then 'true' else 'false' end || ',\"fraud_score\":' || printf('%.4f', frauds * 0.2) || '}'"
DECIDED = "frauds, frauds * cast(0.2 as double) as fraud_score, frauds < 3 as approved"
EQ = f"with {EMBEDDED}, queries as (select orig_id as qid, q from emb where orig_id % 20 = 0)"


def kmeans(rounds: int) -> str:
    """CTEs up to c{rounds}, the centroids (cluster_id, x)."""
    size = f"(select greatest(least({SAMPLE}, count(*)), {K}) from refs)"
    parts = [
        f"places as (select i as place, i * (select count(*) from refs) // {size} as orig_id from range({max(SAMPLE, K)}) t(i) where i < {size})",
        "samp as (select p.place, r.orig_id, r.q from places p join refs r on r.orig_id = p.orig_id)",
        f"c0 as (select c as cluster_id, list_transform(s.q, lambda v: cast(v as double)) as x from range({K}) t(c) join samp s on s.place = c * {size} // {K})",
    ]
    for i in range(rounds):
        parts.append(f"a{i} as (select place, q, cluster_id from (select s.place, s.q, c.cluster_id, row_number() over (partition by s.place order by {dist('s.q', 'c.x', D, 'double')}, c.cluster_id) as rn from samp s, c{i} c) where rn = 1)")
        means = ", ".join(f"cast(sum(q[{j}]) as double) / count(*)" for j in range(1, D + 1))
        parts.append(f"c{i + 1} as (select c.cluster_id, coalesce(m.x, c.x) as x from c{i} c left join (select cluster_id, [{means}] as x from a{i} group by cluster_id) m on m.cluster_id = c.cluster_id)")
    return ", ".join(parts)


_LO = ", ".join(f"min(q[{j}])" for j in range(1, D + 1))
_HI = ", ".join(f"max(q[{j}])" for j in range(1, D + 1))
_ZERO = "[" + ", ".join(["0"] * D) + "]"
INDEX = (
    f"{BASE}, {kmeans(ROUNDS)}, "
    f"asg as (select orig_id, q, label, cluster_id from (select r.*, c.cluster_id, row_number() over (partition by r.orig_id order by {dist('r.q', 'c.x', D, 'double')}, c.cluster_id) as rn from refs r, c{ROUNDS} c) where rn = 1), "
    f"boxes as (select cluster_id, count(*) as n, [{_LO}] as lo, [{_HI}] as hi from asg group by cluster_id), "
    f"cl as (select c.cluster_id, c.x, coalesce(b.n, 0) as n, coalesce(b.lo, {_ZERO}) as lo, coalesce(b.hi, {_ZERO}) as hi from c{ROUNDS} c left join boxes b on b.cluster_id = c.cluster_id), "
    f"offs as (select cluster_id, n, cast(coalesce(sum(n) over (order by cluster_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start_off from cl), "
    f"cdist as (select a.qid, a.q, c.cluster_id, {dist('a.q', 'c.x', D, 'double')} as cd from queries a, cl c where c.n > 0), "
    "probed as (select qid, q, cluster_id, cd, probe from (select *, row_number() over (partition by qid order by cd, cluster_id) as probe from cdist) where probe <= 1), "
    f"seed as (select * from (select p.qid, a.orig_id, {dist('p.q', 'a.q', D)} as d, row_number() over (partition by p.qid order by {dist('p.q', 'a.q', D)}, a.orig_id) as rank from probed p join asg a on a.cluster_id = p.cluster_id) where rank <= 5), "
    "worst as (select qid, d as w0 from seed where rank = 5), "
    f"more as (select a.qid, c.cluster_id, {bound('a.q', 'c.lo', 'c.hi', D)} as lb, w0 from queries a left join worst w on w.qid = a.qid, cl c where c.n > 0), "
    "admitted as (select m.qid, m.cluster_id, m.lb from more m where (m.w0 is null or m.lb <= m.w0) and not exists (select 1 from probed p where p.qid = m.qid and p.cluster_id = m.cluster_id))"
)


def dims(name: str, source: str, key: str, value: str, out: str, width: int, where: str = "") -> str:
    return f"{name} select {key}, j - 1 as dim, {value} as {out} from {source}, range(1, {width + 1}) t(j) {where}"


ORACLE = {
    "quantize_embeddings": dims(f"with {EMBEDDED}", "emb", "orig_id as vec_id", "q[j]", "q", EMB),
    "dequantize_grid": dims(f"with {EMBEDDED}", "emb", "orig_id as vec_id", "cast(cast(q[j] as float) / cast(10000 as float) as double)", "g", EMB),
    "pairwise_sq_l2": f"{EQ} select a.qid, b.orig_id, {dist('a.q', 'b.q', EMB)} as d from queries a, emb b",
    "knn_brute_top5": f"{EQ}, {top5('queries', 'emb', EMB)} select qid, orig_id, cast(d as bigint) as d, cast(rank as integer) as rank from near",
    "knn_vote_score": f"{EQ}, {top5('queries', 'emb', EMB)}, {VOTES} select qid, {DECIDED} from votes",
    "decision_table": f"select {DECIDED} from (select i as frauds from range(6) t(i))",
    "response_body": f"select frauds, {BODY} as body from (select i as frauds from range(6) t(i))",
    "tx_features": f"with {TX}, {FEAT} select tx_id, " + ", ".join(f"f{i}" for i in range(D)) + " from feat",
    "json_features": f"with {TX}, {FEAT} select tx_id, " + ", ".join(f"f{i}" for i in range(D)) + " from feat",
    "tx_quantized": dims(f"with {TX}, {FEAT}, {QUANT}", "vec", "tx_id", "q[j]", "q", D),
    "tx_score": f"{BASE}, {top5('queries', 'refs', D)}, {VOTES} select qid as tx_id, {DECIDED}, {BODY} as body from votes",
    "mcc_lookup": f"with {TX} select tx_id, {RISK} as mcc_risk from tx",
    "mcc_overlay": "select code as mcc_code, cast(risk as float) as risk from (values ('5411', 0.9), ('5812', 0.30), ('5912', 0.20), ('5944', 0.45), ('7801', 0.80), ('7802', 0.75), ('7995', 0.85), ('4511', 0.35), ('5311', 0.25), ('5999', 0.50), ('1234', 0.1)) t(code, risk)",
    "unknown_merchant": f"with {TX} select tx_id, {UNKNOWN} as unknown from tx",
    "unknown_merchant_antijoin": f"with {TX} select tx_id from tx where merchant_no % 5 <> user_id % 5",
    "validate_payload": f"with {TX} select tx_id, not (tx_id % 7 = 1 or tx_id % 11 = 2 or tx_id % 13 = 3 or tx_id % 17 = 4) as is_valid from tx",
    "route_status": f"with {TX} select tx_id, case tx_id % 5 when 0 then 200 when 1 then 404 else case when tx_id % 7 = 1 then 400 when tx_id % 11 = 2 then 413 else 200 end end as status from tx",
    "hour_weekday": "select event_id, cast(hour(ts) as integer) as hour, cast(isodow(ts) - 1 as integer) as weekday from events",
    "minutes_between": f"with {TX} select tx_id, cast({MINUTES} as bigint) as minutes from tx where last_ts is not null",
    "days_from_civil": "select event_id, cast(cast(ts as date) - date '1970-01-01' as bigint) as days from events",
    "systematic_sample": f"{BASE}, {kmeans(0)} select place, orig_id from samp",
    "kmeans_init": dims(f"{BASE}, {kmeans(0)}", "c0", "cluster_id", "x[j]", "x", D),
    "kmeans_step": dims(f"{BASE}, {kmeans(1)}", "c1", "cluster_id", "x[j]", "x", D),
    "kmeans_train": dims(f"{BASE}, {kmeans(ROUNDS)}", f"c{ROUNDS}", "cluster_id", "x[j]", "x", D),
    "assign_clusters": f"{INDEX} select orig_id, cluster_id from asg",
    "cluster_sizes": f"{INDEX} select cluster_id, n from cl",
    "empty_clusters": f"{INDEX} select count(*) as empty from cl where n = 0",
    "cluster_bbox": f"{INDEX} select cluster_id, j - 1 as dim, lo[j] as lo, hi[j] as hi from cl, range(1, {D + 1}) t(j)",
    "cluster_offsets": f"{INDEX} select cluster_id, start_off, start_off + n as end_off from offs",
    "cluster_positions": f"{INDEX} select a.orig_id, a.cluster_id, cast(o.start_off + row_number() over (partition by a.cluster_id order by a.orig_id) - 1 as bigint) as pos from asg a join offs o on o.cluster_id = a.cluster_id",
    "centroid_distance": f"{INDEX} select qid, cluster_id, cd from cdist",
    "nprobe_clusters": f"{INDEX} select qid, cluster_id, cast(probe as integer) as probe from (select *, row_number() over (partition by qid order by cd, cluster_id) as probe from cdist) where probe <= 3",
    "bbox_lower_bound": f"{INDEX} select qid, cluster_id, cast(lb as bigint) as lb from more",
    "repair_candidates": f"{INDEX} select qid, cluster_id, cast(lb as bigint) as lb from admitted",
    "ivf_search": f"{BASE}, {top5('queries', 'refs', D)} select qid, orig_id, cast(d as bigint) as d, cast(rank as integer) as rank from near",
    "ivf_search_stats": f"{INDEX} select s.qid, count(*) as scanned_clusters, cast(sum(c.n) as bigint) as scanned_vectors from (select qid, cluster_id from probed union all select qid, cluster_id from admitted) s join cl c on c.cluster_id = s.cluster_id group by s.qid",
    "small_n_vote": f"{BASE}, few as (select * from refs where orig_id < 3), {top5('queries', 'few', D)}, {VOTES} select qid, {DECIDED} from votes",
    "tie_break_top5": f"{BASE}, twice as (select orig_id * 3 + k as orig_id, q, label from refs, range(3) t(k)), {top5('queries', 'twice', D)} select qid, orig_id, cast(d as bigint) as d, cast(rank as integer) as rank from near",
    "profile_averages": "select requests, avg_parse, avg_search, avg_write from (select seq as requests, avg(parse) over w as avg_parse, avg(search) over w as avg_search, avg(write) over w as avg_write from (select row_number() over (order by event_id) as seq, event_id % 7 + 1 as parse, event_id % 101 + 3 as search, event_id % 5 + 2 as write from events) window w as (order by seq)) where requests % 100 = 0",
    "confusion_matrix": f"{BASE}, {top5('queries', 'refs', D)}, {VOTES}, seen as (select case when v.qid % 300 = 0 then null else v.frauds >= 3 end as flagged, x.fraud from votes v join vec x on x.tx_id = v.qid) select count(*) filter (flagged and fraud = 1) as tp, count(*) filter (not flagged and fraud = 0) as tn, count(*) filter (flagged and fraud = 0) as fp, count(*) filter (not flagged and fraud = 1) as fn, count(*) filter (flagged is null) as errors from seen",
    "p99_score": "select quantile_cont(latency_ms, 0.99) as p99_ms, case when quantile_cont(latency_ms, 0.99) > 2000 then -3000.0 else least(cast(3000 as double), 1000 * log10(1000 / greatest(quantile_cont(latency_ms, 0.99), 1.0))) end as p99_score from (select cast(event_id % 97 as double) / 4 + 0.5 as latency_ms from events)",
    "weighted_error": f"{BASE}, {top5('queries', 'refs', D)}, {VOTES}, seen as (select case when v.qid % 300 = 0 then null else v.frauds >= 3 end as flagged, x.fraud from votes v join vec x on x.tx_id = v.qid), m as (select count(*) filter (flagged and fraud = 0) as fp, count(*) filter (not flagged and fraud = 1) as fn, count(*) filter (flagged is null) as errors, count(*) as total from seen) select fp + 3 * fn + 5 * errors as weighted, cast(fp + fn + errors as double) / total as failure_rate, fp + fn + errors > 0.15 * total as past_cutoff from m",
    "references_json_scan": "select orig_id, label, j - 1 as dim, case when j <= 10 then cast(embedding[j] as double) else 0.0 end as x from (select row_number() over (order by vec_id) - 1 as orig_id, case when label < 3 then 1 else 0 end as label, embedding from embeddings), range(1, 15) t(j)",
    "index_roundtrip": dims(INDEX, "asg", "orig_id, label, cluster_id", "q[j]", "q", D),
    "stream_score": f"{BASE}, {top5('queries', 'refs', D)}, {VOTES} select qid as tx_id, {DECIDED}, {BODY} as body from votes where not (qid % 7 = 1 or qid % 11 = 2 or qid % 13 = 3 or qid % 17 = 4)",
    "nprobe_clamp": f"{INDEX} select asked, qid, cluster_id, cast(probe as integer) as probe from (select *, row_number() over (partition by qid order by cd, cluster_id) as probe from cdist), (values (0), (9999)) t(asked) where probe <= case asked when 0 then 1 else {K} end",
    "readiness": f"{BASE} select count(*) as vectors, cast({K} as bigint) as clusters, count(*) > 0 as ready from refs",
}
