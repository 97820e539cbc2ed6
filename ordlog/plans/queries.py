"""The registered queries of the engine's own operators, each with independent SQL over the same tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ordlog.functions import bloom, coding
from ordlog.model import DELETE, ENTRY_OVERHEAD, NUM_LEVELS, conversation_kv, events_log, head, key_of, table
from ordlog.operators import batches, compaction, files, reads
from ordlog.operators.batches import pressure
from ordlog.plans.ordering import key_range, prefix_sum, ranked
from ordlog.plans.store import Store
from ordlog.sources import edits, runs
from ordlog.sources.scratch import saved, shared_dir

S, KEY, SEEK, LO, HI = 5000, "00000042", "00000033", "00000020", "00000050"
SNAPSHOTS = (2500, 5000)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}

LOG = """log as (select lpad(cast(user_id as varchar), 8, '0') k, event_id + 1 seq, case when event_type = 'error' then 0 else 1 end op,
 props v, event_id // 100 batch_id from events)"""
NEWEST = "(select *, row_number() over (partition by k order by seq desc) rn from log where seq <= {s})"
VIS = f"{LOG}, vis as (select k, v, seq from {NEWEST.format(s='9223372036854775807')} where rn = 1 and op = 1)"
OLD = f"old as (select k, v, seq from {NEWEST.format(s=S)} where rn = 1 and op = 1)"
PLACED = f"""{LOG}, n as (select max(seq) n from log), placed as (select k, seq, op, v,
 case when seq > 0.8 * n then 0 when seq > 0.5 * n then 1 else 2 end as level,
 case when seq > 0.9 * n then 100 when seq > 0.8 * n then 99 when seq > 0.5 * n then 50 + cast(k as bigint) // 50
      else 1 + cast(k as bigint) // 50 end as file_no from log, n)"""
FILES = f"""{PLACED}, files as (select cast(level as integer) as level, cast(file_no as bigint) file_no, min(k) smallest, max(k) largest, count(*) entries,
 cast(sum(1 - op) as bigint) deletes, cast(sum(length(k) + length(v) + 9) as bigint) bytes, max(seq) max_seq from placed group by 1, 2)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def placed(spark: SparkSession, d: str) -> DataFrame:
    """The log dealt to files: the newest fifth in two overlapping files of level 0, the rest in disjoint files of levels 1 and 2."""
    log = events_log(spark, d)
    n, k = head(log), F.col("k").cast("bigint")
    level = F.when(F.col("seq") > 0.8 * n, 0).when(F.col("seq") > 0.5 * n, 1).otherwise(2)
    block = F.floor(k / 50)
    file_no = F.when(F.col("seq") > 0.9 * n, 100).when(F.col("seq") > 0.8 * n, 99).when(F.col("seq") > 0.5 * n, 50 + block).otherwise(1 + block)
    return log.withColumn("level", level).withColumn("file_no", file_no.cast("bigint"))


def file_table(spark: SparkSession, d: str) -> DataFrame:
    return files.stats(placed(spark, d), "level", "file_no")


def written(spark: SparkSession, log: DataFrame, *by: str) -> str:
    """The path of a run with the log's rows, one folder for each value of a column."""
    path = f"{shared_dir(spark)}/ordlog/run-{uuid.uuid4().hex}"
    runs.flush(log, path, *(F.col(c) for c in by))
    return path


# point reads


@query(f"with {VIS} select k, v, seq from vis where k = '{KEY}'")
def get_latest(spark, d):
    return reads.get(events_log(spark, d), KEY)


@query(f"with {LOG}, {OLD} select k, v, seq from old where k = '{KEY}'")
def get_at_snapshot(spark, d):
    return reads.get(events_log(spark, d), KEY, S)


@query(f"""with {VIS}, dead as (select min(k) k from (select k, op, row_number() over (partition by k order by seq desc) rn from log) where rn = 1 and op = 0)
 select w.k, vis.v, vis.seq from (select '{KEY}' k union all select 'absent' union all select k from dead) w left join vis on vis.k = w.k""")
def get_missing(spark, d):
    log = events_log(spark, d)
    dead = reads.newest(log).where(F.col("op") == DELETE).agg(F.min("k").alias("k"))
    wanted = spark.createDataFrame([(KEY,), ("absent",)], "k string").unionByName(dead)
    return reads.multi_get(log, wanted)


@query(f"""with {VIS} select c.k, vis.v, vis.seq from (select distinct lpad(cast(c_custkey as varchar), 8, '0') k from customer where c_custkey < 50) c
 left join vis on vis.k = c.k where vis.k is not null""")
def multi_get(spark, d):
    keys = table(spark, d, "customer").where("c_custkey < 50").select(key_of("c_custkey").alias("k"))
    return reads.multi_get(events_log(spark, d), keys).where("seq is not null")


@query(f"""with {PLACED} select k, v, seq from (select *, row_number() over (partition by k order by level, seq desc) rn from placed) where rn = 1 and op = 1""")
def get_by_precedence(spark, d):
    return reads.by_precedence(placed(spark, d), "level")


@query(f"with {LOG} select k, seq, op, v from log where seq <= {S}")
def visible_log(spark, d):
    return reads.at(events_log(spark, d), S).select("k", "seq", "op", "v")


# ordered scans


@query(f"with {VIS} select k, v, seq, row_number() over (order by k) rn from vis")
def scan_forward(spark, d):
    return reads.scan(events_log(spark, d))


@query(f"with {VIS} select k, v, seq, row_number() over (order by k desc) rn from vis")
def scan_reverse(spark, d):
    return reads.scan(events_log(spark, d), descending=True)


@query(f"with {VIS} select k, v, seq from vis where k >= '{SEEK}' order by k limit 1")
def seek_ge(spark, d):
    return reads.seek(events_log(spark, d), SEEK)


@query(f"with {VIS} select k, v, seq from vis where k >= '{LO}' and k < '{HI}'")
def range_scan(spark, d):
    return reads.visible(reads.between(events_log(spark, d), LO, HI))


@query(f"with {VIS} select k, v, seq from vis order by k limit 10 offset 20")
def scan_page(spark, d):
    return reads.seek(events_log(spark, d), "", n=10, skip=20)


@query("""select substr(k, 1, 8) conv, count(*) turns, min(k) first_k, max(k) last_k from
 (select lpad(cast(conv_id as varchar), 8, '0') || '/' || lpad(cast(turn as varchar), 4, '0') k from conversations)
 where k >= '0000001' and k < '0000002' group by 1""")
def prefix_scan(spark, d):
    got = reads.prefixed(conversation_kv(spark, d), "0000001")
    return got.groupBy(F.substring("k", 1, 8).alias("conv")).agg(F.count("*").alias("turns"), F.min("k").alias("first_k"), F.max("k").alias("last_k"))


@query(f"with {VIS} select min(k) first_k, max(k) last_k from vis")
def first_last(spark, d):
    return reads.first_last(events_log(spark, d))


@query(f"with {VIS} select k, lag(k) over (order by k) prev_k, lead(k) over (order by k) next_k from vis")
def neighbours(spark, d):
    return reads.with_neighbours(events_log(spark, d))


@query(f"with {LOG} select k, seq, op, v, row_number() over (order by seq desc) version_rank from log where k = '00000007'")
def key_history(spark, d):
    return reads.history(events_log(spark, d), "00000007")


@query(f"with {LOG} select k, seq, op, v, row_number() over (partition by k order by seq desc) version_rank from log")
def versions_scan(spark, d):
    w = Window.partitionBy("k").orderBy(F.desc("seq"))
    return events_log(spark, d).select("k", "seq", "op", "v", F.row_number().over(w).cast("bigint").alias("version_rank"))


@query(f"""with {LOG}, dead as (select k, max(seq) m from log where op = 0 and seq <= {S} group by k)
 select log.k, v, seq from log left join dead on dead.k = log.k where op = 1 and seq <= {S} and seq > coalesce(m, 0)""")
def scan_versions(spark, d):
    return reads.versions(events_log(spark, d), S)


@query(f"with {LOG} select k, seq from log where op = 0")
def tombstones(spark, d):
    return events_log(spark, d).where(F.col("op") == DELETE).select("k", "seq")


@query(f"""with {VIS}, {OLD} select coalesce(old.k, vis.k) k, case when old.k is null then 'I' when vis.k is null then 'D' else 'U' end as change,
 old.seq old_seq, vis.seq new_seq from old full outer join vis on old.k = vis.k where old.k is null or vis.k is null or old.seq <> vis.seq""")
def snapshot_diff(spark, d):
    return reads.diff(events_log(spark, d), S)


@query(f"with {LOG} select min(s) oldest, max(s) newest from (select max(seq) // 4 s from log union all select max(seq) // 2 from log union all select max(seq) from log)")
def snapshot_bounds(spark, d):
    n = events_log(spark, d).agg(F.max("seq").alias("n"))
    return n.select(F.explode(F.array(F.expr("n div 4"), F.expr("n div 2"), "n")).alias("s")).agg(F.min("s").alias("oldest"), F.max("s").alias("newest"))


@query(f"""with {LOG}, r as (select k, seq, ((seq - 1) * 4) // (select max(seq) from log) run from log)
 select k, seq, cast(run as bigint) run, row_number() over (order by k, seq desc, run) rn from r""")
def merge_runs(spark, d):
    """The whole log, cut into four runs."""
    log = events_log(spark, d)
    run = F.expr(f"((seq - 1) * 4) div {max(1, head(log))}")
    merged = saved(reads.merge(*(log.where(run == i) for i in range(4))))
    order = [F.col("k"), F.desc("seq"), F.col("run")]
    return prefix_sum(merged, key_range(merged, "k"), order, F.lit(1), "rn").select("k", "seq", F.col("run").cast("bigint"), (F.col("rn") + 1).cast("bigint").alias("rn"))


@query(f"with {FILES} select f.file_no, p.k, p.seq from files f join placed p on p.file_no = f.file_no where f.level = 1")
def level_scan(spark, d):
    """Files of one level, written and read back."""
    path = written(spark, placed(spark, d).where("level = 1"), "file_no")
    return spark.read.parquet(path).select(F.col("part").cast("bigint").alias("file_no"), "k", "seq")


@query(f"with {FILES} select f.file_no, p.k, count(*) n from files f join placed p on p.file_no = f.file_no and p.k between f.smallest and f.largest where f.largest >= '00000060' and f.smallest <= '00000080' and p.k between '00000060' and '00000080' group by 1, 2")
def index_then_data(spark, d):
    index = files.overlapping(file_table(spark, d), "00000060", "00000080").select("file_no")
    return placed(spark, d).where(F.col("k").between("00000060", "00000080")).join(index, "file_no").groupBy("file_no", "k").agg(F.count("*").alias("n"))


# logs and batches


@query(f"with {LOG} select k, seq, op, v, batch_id from log")
def wal_scan(spark, d):
    return events_log(spark, d)


@query(f"with {LOG} select k, seq, op, v from log where seq >= {S}")
def wal_scan_from(spark, d):
    return events_log(spark, d).where(F.col("seq") >= S).select("k", "seq", "op", "v")


@query(f"with {LOG} select k, seq, op, v from log where batch_id >= 30")
def recover(spark, d):
    log = events_log(spark, d).where("batch_id >= 30")
    packed = batches.pack(log)
    return batches.explode(packed).unionByName(batches.explode(packed)).select("k", "seq", "op", "v").dropDuplicates(["seq"])  # replayed twice


@query(f"with {LOG} select batch_id, count(*) n, cast(sum(op) as bigint) puts, min(seq) base_seq from log group by 1")
def batch_counts(spark, d):
    return batches.counts(events_log(spark, d))


@query(f"with {LOG} select batch_id, seq, row_number() over (partition by batch_id order by seq) - 1 as ordinal, op, k, v from log")
def batch_explode(spark, d):
    return batches.explode(batches.pack(events_log(spark, d)))


@query("""select lpad(cast(conv_id as varchar), 8, '0') || '/' || lpad(cast(turn as varchar), 4, '0') k, case when role = 'user' then 0 else 1 end op,
 100 + row_number() over (order by conv_id, turn) seq from conversations""")
def apply_batch(spark, d):
    c = table(spark, d, "conversations")
    b = c.select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("ordinal"), F.when(F.col("role") == "user", 0).otherwise(1).alias("op"), F.concat(key_of("conv_id"), F.lit("/"), key_of("turn", 4)).alias("k"))
    return batches.sequence(b, 100).select("k", "op", "seq")


@query(f"""with {LOG}, b as (select batch_id, cast(sum(length(k) + length(v)) as bigint) bytes from log group by 1),
 c as (select *, coalesce(sum(bytes) over (order by batch_id rows between unbounded preceding and 1 preceding), 0) cum from b)
 select cast(floor(cum / 4096) as bigint) grp, count(*) batches, cast(sum(bytes) as bigint) bytes from c group by 1""")
def group_commit(spark, d):
    return batches.commit_groups(events_log(spark, d), 4096)


@query(f"""with recursive {LOG}, b as (select batch_id, cast(sum(length(k) + length(v)) as bigint) bytes from log group by 1),
 g as (select batch_id, bytes, cast(0 as bigint) grp, bytes held from b where batch_id = 0 union all
 select b.batch_id, b.bytes, case when g.held + b.bytes > 65536 then g.grp + 1 else g.grp end, case when g.held + b.bytes > 65536 then b.bytes else g.held + b.bytes end
 from g join b on b.batch_id = g.batch_id + 1) select batch_id, grp from g""")
def group_commit_greedy(spark, d):
    """The exact rule over the whole log."""
    return batches.exact_groups(events_log(spark, d), 65536).select("batch_id", "grp")


SIZE = """(length(k) + 8 + case when length(k) + 8 < 128 then 1 else 2 end + octet_length(encode(v)) + case when octet_length(encode(v)) < 128 then 1
 when octet_length(encode(v)) < 16384 then 2 else 3 end)"""


@query(f"""with {LOG}, c as (select *, coalesce(sum({SIZE} + {ENTRY_OVERHEAD}) over (order by seq rows between unbounded preceding and 1 preceding), 0) cum from log)
 select cast(floor(cum / 65536) as bigint) buffer, count(*) n, min(seq) first_seq, max(seq) last_seq from c group by 1""")
def memtable_rotation(spark, d):
    return batches.buffers(events_log(spark, d), 65536).groupBy("buffer").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(f"""with recursive {LOG}, c as (select *, coalesce(sum({SIZE} + {ENTRY_OVERHEAD}) over (order by seq rows between unbounded preceding and 1 preceding), 0) cum from log),
 b(buffer, cum) as (select cast(0 as bigint), cast(0 as hugeint) union all select b.buffer + 1, cast(min(c.cum) as hugeint) from b join c on c.cum > b.cum + 65536 group by b.buffer, b.cum)
 select buffer, count(*) n, min(seq) first_seq, max(seq) last_seq from (select seq, (select max(buffer) from b where b.cum <= c.cum) buffer from c) group by 1""")
def memtable_rotation_exact(spark, d):
    """A new buffer begins once the one before it is over its size, and counts from nothing."""
    return batches.exact_buffers(events_log(spark, d), 65536).groupBy("buffer").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(f"with {LOG} select cast(sum({SIZE} + {ENTRY_OVERHEAD}) as bigint) bytes from log")
def memory_usage(spark, d):
    return events_log(spark, d).agg(F.sum(coding.entry_size(F.col("k"), F.col("v")) + ENTRY_OVERHEAD).alias("bytes"))


@query("select cast(n as bigint) files, case when n >= 12 then 'stop' when n >= 8 then 'slow' else 'go' end as state from range(0, 15) t(n)")
def write_pressure(spark, d):
    return spark.createDataFrame([(n, pressure(n)) for n in range(15)], "files bigint, state string")


# runs and levels


@query(f"with {LOG} select k, seq, op, v from log")
def flush_run(spark, d):
    """The whole log as a sorted run, written and read back."""
    return runs.scan(spark, [written(spark, events_log(spark, d))])


@query(f"with {PLACED} select k, seq, op, v from placed where file_no = 1")
def run_scan(spark, d):
    """One file of the written runs, read by its folder."""
    path = written(spark, placed(spark, d), "file_no")
    return runs.scan(spark, [f"{path}/part=1"]).orderBy("k", F.desc("seq"))


@query(f"with {PLACED} select k, seq, op, v from placed where file_no = 1 and k = '{KEY}' order by seq desc limit 1")
def run_point_lookup(spark, d):
    path = written(spark, placed(spark, d).where("file_no = 1"))
    return reads.newest(runs.scan(spark, [path]).where(F.col("k") == KEY))


@query(f"with {VIS} select k, v, seq from vis")
def store_scan(spark, d):
    """The log written to a store in two batches of writes, flushed, compacted and read back."""
    db = Store.open(spark, f"{shared_dir(spark)}/ordlog/store-{uuid.uuid4().hex}")
    log = events_log(spark, d)
    rows = log.select("batch_id", F.col("seq").cast("int").alias("ordinal"), "op", "k", "v")
    half = (head(log) // 200) or 1
    db.write(rows.where(F.col("batch_id") < half))
    db.flush()
    db.write(rows.where(F.col("batch_id") >= half))
    db.compact_range()
    return db.scan().select("k", "v", "seq")


@query(f"with {FILES} select * from files")
def file_stats(spark, d):
    return file_table(spark, d)


@query(f"with {FILES} select level, file_no from files where smallest <= '{KEY}' and largest >= '{KEY}'")
def candidate_files(spark, d):
    return files.candidates(file_table(spark, d), KEY).select("level", "file_no")


@query(f"with {FILES} select level, largest, file_no from (select *, row_number() over (partition by level order by largest) rn from files where level > 0 and largest >= '{KEY}') where rn = 1")
def find_file(spark, d):
    return files.find(file_table(spark, d), KEY)


@query(f"with {FILES} select a.file_no a, b.file_no b from files a join files b on a.file_no < b.file_no and a.smallest <= b.largest and b.smallest <= a.largest")
def overlap_join(spark, d):
    return files.overlaps(file_table(spark, d))


@query(f"""with {FILES}, f as (select *, max(largest) over (order by smallest, file_no rows between unbounded preceding and 1 preceding) reach from files where level > 0),
 g as (select *, sum(case when reach is null or smallest > reach then 1 else 0 end) over (order by smallest, file_no) island from f)
 select cast(island as bigint) island, count(*) files, min(smallest) smallest, max(largest) largest from g group by 1""")
def file_islands(spark, d):
    return files.islands(file_table(spark, d).where("level > 0")).withColumn("island", F.col("island").cast("bigint"))


ZERO = f"""{LOG}, zero as (select cast(cast(k as bigint) // 40 as bigint) file_no, min(k) smallest, max(k) largest from log where (cast(k as bigint) // 40) % 5 <> 4 group by 1
 union all select 1000 + (cast(k as bigint) + 20) // 40, min(k), max(k) from log where ((cast(k as bigint) + 20) // 40) % 5 in (1, 2) group by 1)"""


@query(f"""with recursive {ZERO}, c(file_no, smallest, largest) as (select * from zero where file_no = 1 union
 select z.file_no, z.smallest, z.largest from c join zero z on z.smallest <= c.largest and z.largest >= c.smallest) select file_no, smallest, largest from c""")
def l0_closure(spark, d):
    """The level-0 files that hang together with one."""
    k = F.col("k").cast("bigint")
    log, agg = events_log(spark, d), [F.min("k").alias("smallest"), F.max("k").alias("largest")]
    own = log.withColumn("b", F.floor(k / 40)).where("b % 5 <> 4").groupBy(F.col("b").alias("file_no")).agg(*agg)
    other = log.withColumn("b", F.floor((k + 20) / 40)).where("b % 5 in (1, 2)").groupBy((F.col("b") + 1000).alias("file_no")).agg(*agg)
    return files.closure(own.unionByName(other).withColumn("level", F.lit(0)), 1).select("file_no", "smallest", "largest")


@query(f"""with {FILES}, g as (select level, count(*) files, cast(sum(bytes) as bigint) bytes from files group by 1),
 s as (select *, case when level = 0 then files / 4.0::double else bytes / (10485760.0::double * pow(10, level - 1)) end as score from g)
 select *, row_number() over (order by score desc, level) pick from s""")
def level_scores(spark, d):
    return files.scores(file_table(spark, d))


@query(f"""with {FILES} select cast(l.l as integer) as level, count(file_no) files, round(coalesce(sum(bytes), 0)::double / 1048576, 1) mb
 from range(0, {NUM_LEVELS}) l(l) left join files on files.level = l.l group by 1""")
def level_stats(spark, d):
    return files.level_stats(file_table(spark, d))


@query(f"with {FILES} select cast(l.l as integer) as level, count(file_no) files from range(0, {NUM_LEVELS}) l(l) left join files on files.level = l.l group by 1")
def num_files_at_level(spark, d):
    return files.level_stats(file_table(spark, d)).select("level", "files")


SPARSE = f"{PLACED}, files as (select 1 as level, cast(cast(k as bigint) // 10 as bigint) file_no, min(k) smallest, max(k) largest from placed where level = 1 group by 1, 2 union all select 2, 1000, min(k), max(k) from placed where k < '00000040')"


@query(f"with {SPARSE} select file_no, smallest, largest from files f where level = 1 and not exists (select 1 from files g where g.level in (2, 3) and g.smallest <= f.largest and f.smallest <= g.largest)")
def trivial_moves(spark, d):
    p = placed(spark, d)
    agg = [F.min("k").alias("smallest"), F.max("k").alias("largest")]
    upper = p.where("level = 1").groupBy(F.lit(1).alias("level"), F.floor(F.col("k").cast("bigint") / 10).alias("file_no")).agg(*agg)
    lower = p.where(F.col("k") < "00000040").groupBy(F.lit(2).alias("level"), F.lit(1000).cast("bigint").alias("file_no")).agg(*agg)
    return files.trivial_moves(upper.unionByName(lower), 1).select("file_no", "smallest", "largest")


@query(f"""with {FILES}, q as (select distinct k from log), h as (select file_no, count(*) n from q join files on q.k between smallest and largest group by 1)
 select f.file_no, coalesce(n, 0) seeks, greatest(1, bytes // 16384) budget, coalesce(n, 0) > greatest(1, bytes // 16384) as over
 from files f left join h on h.file_no = f.file_no""")
def seek_budget(spark, d):
    return files.seek_budget(file_table(spark, d), events_log(spark, d).select("k").distinct())


@query(f"""with {FILES}, r(lo, hi) as (values ('00000000', '00000010'), ('00000500', '00000600'), ('', 'zzz')),
 m as (select lo, hi, coalesce(max(case when level = 0 then 1 end), 0) z, coalesce(max(case when level = 1 then 1 end), 0) o,
 coalesce(max(case when level = 2 then 1 end), 0) t from r left join files on largest >= lo and smallest <= hi group by 1, 2)
 select lo, hi, cast(case when z = 1 or o = 1 then 0 when t = 1 then 1 else 2 end as integer) as level from m""")
def pick_flush_level(spark, d):
    return files.flush_levels(file_table(spark, d), spark.createDataFrame([("00000000", "00000010"), ("00000500", "00000600"), ("", "zzz")], "lo string, hi string"))


@query(f"""with {FILES}, s as (select level from (select level, case when level = 0 then count(*) / 4.0 else sum(bytes) / (10485760.0 * pow(10, level - 1)) end as score from files group by 1) order by score desc, level limit 1),
 i as (select f.* from files f, s where f.level = s.level), r as (select min(smallest) lo, max(largest) hi from i)
 select 'input' as role, file_no from i union all select 'parent', f.file_no from files f, s, r where f.level = s.level + 1 and f.largest >= lo and f.smallest <= hi
 union all select 'grandparent', f.file_no from files f, s, r where f.level = s.level + 2 and f.largest >= lo and f.smallest <= hi""")
def pick_compaction(spark, d):
    f = file_table(spark, d)
    level = files.scores(f).where("pick = 1").first()["level"]
    own = f.where(F.col("level") == level)
    r = own.agg(F.min("smallest"), F.max("largest")).first()
    part = lambda df, role: df.select(F.lit(role).alias("role"), "file_no")
    return part(own, "input").unionByName(part(files.overlapping(f, *r, level + 1), "parent")).unionByName(part(files.overlapping(f, *r, level + 2), "grandparent"))


@query(f"""with {FILES}, i as (select * from files where level = 1 order by largest > '{KEY}' desc, smallest limit 1),
 p as (select f.* from files f, i where f.level = 2 and f.largest >= i.smallest and f.smallest <= i.largest)
 select 'input' as role, file_no from i union all select 'parent', file_no from p""")
def pick_after_pointer(spark, d):
    """The file of level 1 after the pointer, with what it meets in the next levels."""
    return files.pick(file_table(spark, d), 1, KEY)


@query(f"""with {FILES}, i as (select * from files where level = 0), p as (select f.* from files f, (select min(smallest) lo, max(largest) hi from i) where f.level = 1 and largest >= lo and smallest <= hi)
 select 'input' as role, file_no from i union all select 'parent', file_no from p union all select 'grandparent', file_no from files f,
 (select min(smallest) lo, max(largest) hi from (select smallest, largest from i union all select smallest, largest from p)) where f.level = 2 and largest >= lo and smallest <= hi""")
def pick_from_level0(spark, d):
    """A file of level 0 with all that overlap it, and what they meet."""
    return files.pick(file_table(spark, d), 0)


@query(f"""with {FILES}, e as (select level, file_no, 1 as n from files union all select level, file_no, -1 from files where level = 1)
 select level, file_no from e group by 1, 2 having sum(n) > 0""")
def manifest_replay(spark, d):
    f = file_table(spark, d).select("level", "file_no")
    return files.replay(f.withColumn("action", F.lit("ADD")).unionByName(f.where("level = 1").withColumn("action", F.lit("REMOVE"))))


@query(f"with {FILES} select level, file_no, bytes, smallest, largest from files where level <> 1")
def edit_log(spark, d):
    """The file table as version edits, written to bytes, read again and replayed: all files come, then those of level 1 go."""
    rows = file_table(spark, d).collect()  # metadata: a row for each file
    log = [edits.Edit(new=[(r.level, r.file_no, r.bytes, r.smallest.encode(), r.largest.encode())]) for r in rows] + [edits.Edit(deleted=[(1, r.file_no) for r in rows if r.level == 1])]
    read = edits.frame(spark, [edits.decode(edits.encode(e)) for e in log])
    return files.replay(read).join(read.where("action = 'ADD'").drop("version", "action"), ["level", "file_no"]).select("level", "file_no", "bytes", F.col("smallest").cast("string"), F.col("largest").cast("string"))


@query(f"with {FILES} select file_no from files where level = 1")
def obsolete_files(spark, d):
    f = file_table(spark, d).select("level", "file_no")
    return files.obsolete(f, manifest_replay(spark, d)).select("file_no")


@query(f"""with {LOG}, r as (select k, cast(sum(length(k) + length(v) + 9) as bigint) n from log group by 1),
 c as (select k, cast(coalesce(sum(n) over (order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from r)
 select k, "offset", cast(floor("offset" / 4096) as bigint) block from c""")
def approx_offset(spark, d):
    per = events_log(spark, d).groupBy("k").agg(F.sum(F.length("k").cast("bigint") + F.length("v") + 9).alias("n"))
    return files.approximate_offset(per, F.col("n"))


@query(f"""with {VIS}, r as (select k, row_number() over (order by k) rn from vis), g as (select *, (rn - 1) // 16 grp, lag(k) over (partition by (rn - 1) // 16 order by rn) p from r)
 select rn, k, grp, coalesce((select max(i) from range(1, 9) t(i) where substr(k, 1, cast(i as integer)) = substr(p, 1, cast(i as integer))), 0) shared,
 8 - coalesce((select max(i) from range(1, 9) t(i) where substr(k, 1, cast(i as integer)) = substr(p, 1, cast(i as integer))), 0) unshared from g""")
def prefix_compression_stats(spark, d):
    return files.prefix_compression(ranked(reads.visible(events_log(spark, d)).select("k"), "k"))


@query(f"""with {VIS}, r as (select k, v, row_number() over (order by k) rn from vis), g as (select *, (rn - 1) // 16 grp, lag(k) over (partition by (rn - 1) // 16 order by rn) p from r),
 h as (select *, coalesce((select max(i) from range(1, 9) t(i) where substr(k, 1, cast(i as integer)) = substr(p, 1, cast(i as integer))), 0) shared, octet_length(encode(v)) n from g),
 t as (select count(*) entries, count(distinct grp) restarts, cast(sum(2 + case when n < 128 then 1 when n < 16384 then 2 else 3 end + 8 - shared + n) as bigint) buffer from h)
 select *, buffer + 4 * restarts + 4 estimate from t""")
def block_size_estimate(spark, d):
    return files.block_size_estimate(ranked(reads.visible(events_log(spark, d)).select("k", "v"), "k"))


# compaction


@query(f"with {VIS} select k, v, seq from vis")
def compact(spark, d):
    return compaction.live(events_log(spark, d)).select("k", "v", "seq")


KEEP = f"{LOG}, b as (select *, case when seq <= 2500 then 0 when seq <= 5000 then 1 else 2 end i from log), kept as (select k, seq, op, v from (select *, row_number() over (partition by k, i order by seq desc) rn from b) where rn = 1)"


@query(f"with {KEEP} select k, seq, op, v from kept")
def compact_with_snapshot(spark, d):
    return compaction.keep(events_log(spark, d).select("k", "seq", "op", "v"), SNAPSHOTS)


@query(f"with {KEEP}, m as (select *, min(seq) over (partition by k) first_seq from kept) select k, seq, op, v from m where not (op = 0 and seq = first_seq and seq <= 2500)")
def compact_drop_tombstones(spark, d):
    return compaction.compact(events_log(spark, d).select("k", "seq", "op", "v"), SNAPSHOTS)


@query(f"with {VIS} select k, seq, op, v from log where k < '{LO}' or k > '{HI}' union all select k, seq, 1, v from vis where k between '{LO}' and '{HI}'")
def compact_range(spark, d):
    return compaction.compact_range(events_log(spark, d).select("k", "seq", "op", "v"), LO, HI)


@query(f"with {LOG} select k, seq from log a where op = 0 and not exists (select 1 from log b where b.k = a.k and b.seq < a.seq)")
def tombstone_gc(spark, d):
    return compaction.idle_tombstones(events_log(spark, d))


@query(f"""with {FILES} select k, seq from log where op = 0 and not exists (select 1 from files f where f.level = 2 and f.file_no % 3 = 1 and log.k between f.smallest and f.largest)""")
def tombstones_at_base_level(spark, d):
    """Tombstones whose key no deeper file covers."""
    return compaction.base_level_tombstones(events_log(spark, d), file_table(spark, d).where("level = 2 and file_no % 3 = 1").select("smallest", "largest"))


CUTS = f"""{FILES}, r as (select k, cast(sum(length(k) + length(v) + 9) as bigint) n from log group by 1), c as (select k, coalesce(sum(n) over (order by k rows between unbounded preceding and 1 preceding), 0) cum from r),
 g as (select *, coalesce((select sum(bytes) from files where level = 2 and largest < k), 0) over_ from c),
 p(part, cum) as (select cast(0 as bigint), cast(0 as hugeint) union all select p.part + 1, cast(min(c.cum) as hugeint) from p join c on c.cum > p.cum + 65536 group by p.part, p.cum),
 q(passed, over_) as (select cast(0 as bigint), cast((select min(over_) from g) as hugeint) union all select q.passed + 1, cast(min(g.over_) as hugeint) from q join g on g.over_ > q.over_ + 131072 group by q.passed, q.over_)"""


@query(f"""with recursive {CUTS} select k, (select max(part) from p where p.cum <= g.cum) part, (select max(passed) from q where q.over_ <= g.over_) passed from g""")
def cut_output(spark, d):
    """Output files by the exact rules: over so many bytes, or over so many bytes of grandparents passed, each counting anew at its cuts."""
    per = events_log(spark, d).groupBy("k").agg(F.sum(F.length("k").cast("bigint") + F.length("v") + 9).alias("n"))
    return compaction.cut_outputs(per, F.col("n"), file_table(spark, d).where("level = 2"), 65536, 131072).select("k", "part", "passed")


@query(f"""with {FILES}, r as (select k, cast(sum(length(k) + length(v) + 9) as bigint) n from log group by 1), c as (select k, coalesce(sum(n) over (order by k rows between unbounded preceding and 1 preceding), 0) cum from r)
 select k, cast(floor(cum / 65536) as bigint) part, cast(floor(coalesce((select sum(bytes) from files where level = 2 and largest < k), 0) / 131072) as bigint) passed from c""")
def split_output(spark, d):
    per = events_log(spark, d).groupBy("k").agg(F.sum(F.length("k").cast("bigint") + F.length("v") + 9).alias("n"))
    return compaction.split_outputs(per, F.col("n"), file_table(spark, d).where("level = 2"), 65536, 131072).select("k", "part", "passed")


# bloom


def hash_sql(rows: str, seed: int = coding.FILTER_SEED) -> str:
    """SQL for (s, h): the 32-bit hash of each text s, of plain letters, in a table."""
    m, mask = coding.HASH_MULTIPLIER, 0xFFFFFFFF
    byte = "ascii(substr(s, cast({0} as bigint) + 1, 1))"
    word = " + ".join(f"{byte.format(f'4 * i + {j}')} * {256**j}" for j in range(4))
    left = " + ".join(f"case when length(s) % 4 > {j} then {byte.format(f'length(s) - length(s) % 4 + {j}')} * {256**j} else 0 end" for j in range(3))
    step = f"(((a + w) & {mask}) * {m}::ubigint) & {mask}"
    return f"""(select s, cast(case when length(s) % 4 = 0 then h else xor(t, t >> 24) end as bigint) h from (select *, ((((h + ({left})) & {mask})::ubigint) * {m}::ubigint) & {mask} t from (select s, list_reduce(list_concat([xor(((length(s)::ubigint) * {m}::ubigint) & {mask}, {seed}::ubigint)],
 list_transform(range(0, length(s) // 4), lambda i: ({word})::ubigint)), lambda a, w: xor({step}, ({step}) >> 16)) h from {rows})))"""


@query(f"with {LOG}, t as (select distinct s from (select k s from log union all select substr(k, 1, 3 + cast(k as bigint) % 5) || 'x' from log union all select p_name from part)) select s, h from {hash_sql('t')}")
def key_hash(spark, d):
    """The 32-bit hash of texts of all lengths."""
    log = events_log(spark, d).select("k")
    cut = log.select(F.concat(F.substr("k", F.lit(1), (3 + F.col("k").cast("bigint") % 5).cast("int")), F.lit("x")).alias("s"))
    t = log.select(F.col("k").alias("s")).unionByName(cut).unionByName(table(spark, d, "part").select(F.col("p_name").alias("s"))).distinct()
    return t.select("s", coding.hash32(F.col("s")).alias("h"))


BIT = "(select s, ((h + j * d) & 4294967295) % 10000 bit from (select s, h, ((h >> 17) | ((h << 15) & 4294967295)) d from hashed), range(0, 6) r(j))"


@query(f"""with {VIS}, live as (select k from vis where cast(k as bigint) % 2 = 0), probe as (select distinct k s from log where k >= '{LO}'), t as (select s from probe union select k from live),
 hashed as (select * from {hash_sql('t')}), bits as (select * from {BIT}), on_ as (select distinct bit from bits where s in (select k from live))
 select s k, s in (select k from live) as live from probe where not exists (select 1 from bits where bits.s = probe.s and bit not in (select bit from on_))""")
def bloom_may_match(spark, d):
    """The probes that a filter of half the live keys lets through, those among them that it has not seen too."""
    live = saved(reads.visible(events_log(spark, d)).select("k").where(F.col("k").cast("bigint") % 2 == 0))
    probe = events_log(spark, d).select("k").distinct().where(F.col("k") >= LO)
    passed = bloom.may_match(probe, "k", bloom.build(live, "k", 1000))
    return passed.join(live.withColumn("live", F.lit(True)), "k", "left").select("k", F.coalesce("live", F.lit(False)).alias("live"))


@query(f"""with made as (select 'insert-' || i s from range(1000) r(i)), other as (select 'query-' || i s from range(10000) r(i)), t as (select s from made union all select s from other),
 hashed as (select * from {hash_sql('t')}), bits as (select * from {BIT}), on_ as (select distinct bit from bits where s like 'insert-%'),
 f as (select count(*) n from other where not exists (select 1 from bits where bits.s = other.s and bit not in (select bit from on_)))
 select cast(1000 as bigint) keys, cast(0 as bigint) missed, n as let_through from f""")
def bloom_fpr(spark, d):
    """A thousand keys, none missed; of ten thousand others, those let through."""
    made = spark.range(1000).select(F.concat(F.lit("insert-"), "id").alias("k"))
    b = bloom.build(made, "k", 1000)
    other = spark.range(10000).select(F.concat(F.lit("query-"), "id").alias("k"))
    told = bloom.may_match(made, "k", b).select(F.lit(1).alias("own")).unionByName(bloom.may_match(other, "k", b).select(F.lit(0).alias("own")))
    return told.agg(F.sum("own").alias("hit"), F.sum(1 - F.col("own")).alias("let_through")).select(F.lit(1000).cast("bigint").alias("keys"), (1000 - F.col("hit")).alias("missed"), "let_through")


# scalar functions

NAMES = ["000100.log", "000007.ldb", "000008.sst", "000009.dbtmp", "MANIFEST-000003", "CURRENT", "LOCK", "LOG", "LOG.old", "100", "foo.log", "000001.bak"]


@query(f"""with n(name) as (values {", ".join(f"('{n}')" for n in NAMES)}), p as (select name, case when name = 'CURRENT' then 'current' when name = 'LOCK' then 'lock'
 when name in ('LOG', 'LOG.old') then 'info' when regexp_full_match(name, 'MANIFEST-[0-9]+') then 'manifest' when regexp_full_match(name, '[0-9]+[.]log') then 'log'
 when regexp_full_match(name, '[0-9]+[.](ldb|sst)') then 'table' when regexp_full_match(name, '[0-9]+[.]dbtmp') then 'temp' end kind, regexp_extract(name, '([0-9]+)', 1) num from n)
 select name, kind, case when kind is not null then case when num = '' then 0 else cast(num as bigint) end end number from p""")
def parse_file_name(spark, d):
    kind, number = coding.parse_file_name(F.col("name"))
    return spark.createDataFrame([(n,) for n in NAMES], "name string").select("name", kind.alias("kind"), number.alias("number"))


LADDER = " ".join(f"when x < {1 << 7 * n} then {n}" for n in range(1, 9))


@query(f"select event_id, cast(case {LADDER} else 9 end as bigint) n from (select event_id, event_id * event_id * event_id * 1000 x from events)")
def varint_length(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", coding.varint_length(F.col("event_id") * F.col("event_id") * F.col("event_id") * 1000).alias("n"))


@query(f"with {LOG} select seq, seq * 256 + op tag, seq as seq_back, cast(op as bigint) op_back from log")
def tag_roundtrip(spark, d):
    t = events_log(spark, d).select("seq", coding.pack_tag(F.col("seq"), F.col("op")).alias("tag"))
    return t.select("seq", "tag", coding.tag_seq(F.col("tag")).alias("seq_back"), coding.tag_op(F.col("tag")).alias("op_back"))


@query("""select event_id, upper(string_agg(lpad(printf('%x', (x >> (8 * i)) & 255), 2, '0'), '' order by i)) le from
 (select event_id, event_id * 1000003 x from events), range(0, 8) t(i) group by 1""")
def fixed64_le(spark, d):
    return table(spark, d, "events").select("event_id", coding.fixed_le(F.col("event_id") * 1000003).alias("le"))


@query(f"with {LOG} select seq, cast({SIZE} as bigint) size from log")
def entry_size(spark, d):
    return events_log(spark, d).select("seq", coding.entry_size(F.col("k"), F.col("v")).alias("size"))


CRC = """t as (select list(c order by n) t from (select n, list_reduce(list_concat([n::ubigint], range(8)::ubigint[]), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) c
 from range(256) r(n)))"""
BYTES = "list_transform(string_split({0}, ''), lambda c: ascii(c)::ubigint)"
SEED_BYTES = "[(s & 255)::ubigint, ((s >> 8) & 255)::ubigint, ((s >> 16) & 255)::ubigint, ((s >> 24) & 255)::ubigint]"


def crc_sql(listed: str) -> str:
    """SQL for the CRC-32 of a list of bytes, with the table t."""
    return f"cast(xor(list_reduce(list_concat([4294967295::ubigint], {listed}), lambda c, b: xor(t.t[cast(xor(c, b) & 255 as bigint) + 1], c >> 8)), 4294967295::ubigint) as bigint)"


@query(f"with {LOG}, {CRC} select seq, {crc_sql(BYTES.format('k || v'))} crc from log, t")
def checksum(spark, d):
    return events_log(spark, d).select("seq", coding.checksum(F.concat("k", "v")).alias("crc"))


@query(f"with {LOG}, {CRC} select seq, {crc_sql(f'list_concat({SEED_BYTES}, {BYTES.format("k")})')} crc from (select seq, k, (seq * 2654435761) & 4294967295 s from log), t")
def checksum_extended(spark, d):
    """The checksum of a key that goes on from another checksum."""
    seed = (F.col("seq") * 2654435761).bitwiseAND(F.lit(4294967295))
    return events_log(spark, d).select("seq", coding.checksum(F.col("k"), seed).alias("crc"))


@query("select event_id, (((x >> 15) | ((x << 17) & 4294967295)) + 2726488792) & 4294967295 masked, x as back from (select event_id, (event_id * 2654435761) & 4294967295 x from events)")
def crc_mask_roundtrip(spark, d):
    x = table(spark, d, "events").select("event_id", (F.col("event_id") * 2654435761).bitwiseAND(F.lit(4294967295)).alias("x"))
    m = x.select("event_id", coding.crc_mask(F.col("x")).alias("masked"))
    return m.select("event_id", "masked", coding.crc_unmask(F.col("masked")).alias("back"))


@query("""with w as (select p_partkey, split_part(p_name, ' ', 1) || '-' || p_brand a, split_part(p_name, ' ', 1) || '-' || p_type b from part),
 n as (select *, coalesce((select min(i) from range(1, 200) t(i) where i <= least(length(a), length(b)) and substr(a, cast(i as integer), 1) <> substr(b, cast(i as integer), 1)), 0) i from w)
 select p_partkey, case when i > 0 and ascii(substr(a, cast(i as integer), 1)) < 127 and ascii(substr(a, cast(i as integer), 1)) + 1 < ascii(substr(b, cast(i as integer), 1))
 then substr(a, 1, cast(i - 1 as integer)) || chr(ascii(substr(a, cast(i as integer), 1)) + 1) else a end sep from n""")
def shortest_separator(spark, d):
    w = F.split_part("p_name", F.lit(" "), F.lit(1))
    p = table(spark, d, "part").select("p_partkey", F.concat(w, F.lit("-"), "p_brand").alias("a"), F.concat(w, F.lit("-"), "p_type").alias("b"))
    return p.select("p_partkey", coding.shortest_separator(F.col("a"), F.col("b")).alias("sep"))


@query("select p_partkey, chr(ascii(substr(p_name, 1, 1)) + 1) succ from part")
def short_successor(spark, d):
    return table(spark, d, "part").select("p_partkey", coding.short_successor(F.col("p_name")).alias("succ"))


@query(f"with {LOG} select seq, substr(k, 3, 4) part from log")
def key_substring(spark, d):
    return events_log(spark, d).select("seq", F.substring("k", 3, 4).alias("part"))


@query("select doc_id, cast(octet_length(encode(source)) as bigint) key_bytes, cast(octet_length(encode(text)) as bigint) value_bytes, cast(length(text) as bigint) value_chars from documents")
def key_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("source").cast("bigint").alias("key_bytes"), F.octet_length("text").cast("bigint").alias("value_bytes"), F.length("text").cast("bigint").alias("value_chars"))


X = "event_id * event_id * event_id * 1000"


@query(f"""with n as (select event_id, {X} x from events), g as (select event_id, x, i, (x >> (7 * i)) & 127 b, x >> (7 * (i + 1)) > 0 as more from n, range(0, 9) r(i) where i = 0 or x >> (7 * i) > 0)
 select event_id, lower(string_agg(lpad(printf('%x', b + case when more then 128 else 0 end), 2, '0'), '' order by i)) bytes, any_value(x) as back, cast(count(*) as bigint) as next from g group by 1""")
def varint_roundtrip(spark, d):
    e = table(spark, d, "events").select("event_id", coding.varint(F.expr(X)).alias("b"))
    told = coding.varint_decode(F.concat(F.lit(b"\x80\x01"), "b", F.lit(b"\xff")), 2)
    return e.select("event_id", F.lower(F.hex("b")).alias("bytes"), told["value"].alias("back"), (told["next"] - 2).cast("bigint").alias("next"))


@query("""select event_id, x as wide, x & 4294967295 narrow from (select event_id, event_id * 1000003 - 5000000 x from events)""")
def fixed_roundtrip(spark, d):
    """Little-endian bytes and back, of eight bytes with a sign and of four without."""
    e = table(spark, d, "events").select("event_id", (F.col("event_id") * 1000003 - 5000000).alias("x"))
    wide, narrow = F.unhex(coding.fixed_le(F.col("x"))), F.unhex(coding.fixed_le(F.col("x"), 4))
    return e.select("event_id", coding.fixed_decode(wide).alias("wide"), coding.fixed_decode(narrow, 4).alias("narrow"))


@query("select doc_id, source as value, cast(octet_length(encode(source)) + 1 as integer) as next from documents where source is not null")
def length_prefixed_roundtrip(spark, d):
    docs = table(spark, d, "documents").where("source is not null")
    told = coding.length_prefixed_decode(coding.length_prefixed(F.col("source")))
    return docs.select("doc_id", told["value"].cast("string").alias("value"), told["next"].cast("int").alias("next"))


RAISED = """n as (select *, coalesce((select min(i) from range(1, 200) t(i) where i <= least(length(a), length(b)) and substr(a, cast(i as integer), 1) <> substr(b, cast(i as integer), 1)), 0) i from w),
 s as (select *, case when i > 0 and ascii(substr(a, cast(i as integer), 1)) + 1 < ascii(substr(b, cast(i as integer), 1)) then substr(a, 1, cast(i - 1 as integer)) || chr(ascii(substr(a, cast(i as integer), 1)) + 1) else a end sep from n)"""


@query(f"""with w as (select p_partkey, split_part(p_name, ' ', 1) || '-' || p_brand a, split_part(p_name, ' ', 1) || '-' || p_type b from part), {RAISED}
 select p_partkey, case when length(sep) < length(a) and a < sep then sep else a end as user_key, case when length(sep) < length(a) and a < sep then -255 else p_partkey * 256 + 1 end as tag from s""")
def internal_separator(spark, d):
    """The shortened key between two internal keys, with the tag that seeks before all of its versions."""
    w = F.split_part("p_name", F.lit(" "), F.lit(1))
    key = lambda other: coding.internal_key(F.concat(w, F.lit("-"), other), F.col("p_partkey"), F.lit(1))
    got = table(spark, d, "part").select("p_partkey", coding.internal_separator(key("p_brand"), key("p_type")).alias("s"))
    return got.select("p_partkey", coding.user_key(F.col("s")).cast("string").alias("user_key"), coding.internal_tag(F.col("s")).alias("tag"))


@query("select p_partkey, case when length(p_name) > 1 then chr(ascii(substr(p_name, 1, 1)) + 1) else p_name end as user_key, case when length(p_name) > 1 then -255 else p_partkey * 256 end as tag from part")
def internal_successor(spark, d):
    got = table(spark, d, "part").select("p_partkey", coding.internal_successor(coding.internal_key(F.col("p_name"), F.col("p_partkey"), F.lit(0))).alias("s"))
    return got.select("p_partkey", coding.user_key(F.col("s")).cast("string").alias("user_key"), coding.internal_tag(F.col("s")).alias("tag"))


@query(f"with {LOG} select seq, case op when 0 then 'deletion' else 'value' end as kind, case seq % 5 when 0 then 'zero' when 1 then 'full' when 2 then 'first' when 3 then 'middle' else 'last' end as record from log")
def decode_types(spark, d):
    return events_log(spark, d).select("seq", coding.value_type(F.col("op")).alias("kind"), coding.record_type(F.col("seq") % 5).alias("record"))
