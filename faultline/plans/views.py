"""Commit and crash-log views over the given tables.

The given documents carry no kernel vocabulary, so each document row becomes one
commit (subject, trailers, diff and files follow from ``doc_id``; the whole
document text is the commit body) and each event row becomes one crash log, which
opens with a console line of the event's user, type and properties.
Every column is an expression both Spark SQL and ANSI engines read the same
way; ``{arr}`` stands for the array constructor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .stage import spread

PREFIXES = ["mm", "fs", "net", "block", "kernel", "drivers", "usb", "bpf", "rcu", "kvm", "security",
            "sched", "x86/mm"]
FOLDERS = ["mm", "fs/ext4", "net/core", "block", "kernel/sched", "drivers/net", "drivers/usb/core",
           "kernel/bpf", "kernel/rcu", "virt/kvm", "security/selinux", "kernel/sched", "arch/x86/mm"]
PHRASES = ["use-after-free", "null pointer dereference", "ABBA deadlock", "memory leak",
           "race condition", "out-of-bounds read", "double free", "soft lockup", "list corruption",
           "size overflow", "refcount leak", "rcu stall", "slow path latency", "wrong option",
           "privilege escalation", "typo"]
FUNCTIONS = ["tcp_sendmsg", "ext4_writepages", "kmem_cache_alloc", "bio_add_page", "do_page_fault",
             "rcu_core", "bpf_prog_alloc", "vfs_write", "netif_rx", "schedule", "usb_probe"]
TRAILERS = [
    "Fixes: 1a2b3c4d5e6f (\"first cut\")",
    "CVE-2023-20198 and cve-2024-1086 apply\nCc: stable@vger.kernel.org",
    "Reported-by: Jane Roe <jane@example.org>\nReviewed-by: Al <al@example.org>",
    "Closes: 77af\nTested-by: Kim Lee <kim@example.org>\nAcked-by: Bo <bo@example.org>",
    "Cc: stable\nResolves: abc123\nSuggested-by: Max Doe", "",
]
# (added lines, removed lines)
DIFFS = [
    (["\tmutex_unlock(&p->lock);", "\treturn -ENOMEM;"], []),
    (["\tspin_lock_irqsave(&q->lock, flags);"], ["\tspin_lock(&q->lock);"]),
    (["\tmutex_unlock(&d->m);", "\tgoto out;"], ["\treturn 0;"]),
    (["\tcond_resched();", "\tspin_unlock(&a);"], ["\tspin_lock(&a);"]),
    (["\tif (!mutex_trylock(&m))", "\t\treturn -EINVAL;"], ["\tmutex_lock(&m);"]),
    (["\tdown_read(&sem);"], ["\tdown_write(&sem);"]),
    ([], ["\tmutex_lock(&twice);"]),
    (["\tmutex_lock(&b);", "\tspin_lock(&a);"], ["\tspin_lock(&a);", "\tmutex_lock(&b);"]),
    (["\tkref_put(&o->ref, release);"], []),
    (["\tkref_get(&o->ref);"], ["\t/* no ref */"]),
    (["\tif (!refcount_inc_not_zero(&r))"], ["\trefcount_inc(&r);"]),
    (["\tget_device(dev);", "\tput_device(dev);"], []),
    (["\trcu_read_lock();", "\trcu_read_unlock();"], []),
    (["\tkfree_rcu(o, rcu);"], ["\tkfree(o);"]),
    (["\tcond_resched();"], []),
    (["\tkfree(buf);", "\tgoto err;"], []),
    (["\tkfree(p);", "\tp = NULL;"], []),
    (["\tp = kzalloc(sizeof(*p), GFP_KERNEL);"], ["\tp = kzalloc(8, GFP_KERNEL);"]),
    (["\tp = kvmalloc(n, GFP_KERNEL);"], ["\tp = kmalloc(n, GFP_KERNEL);"]),
    (["\tif (!p)", "\t\treturn -ENOMEM;"], []),
    (["\tif (i >= ARRAY_SIZE(tab))", "\t\treturn -EINVAL;"], []),
    (["\tatomic_inc(&cnt);"], ["\tcnt++;"]),
    (["\tsmp_mb();"], []),
    (["int helper(int a) {", "\tx = compute(a);"], []),
    (["\t/* comment only */"], ["\t/* old */"]),
]
VERSIONS = ["6.1.0-15-amd64", "5.15.0-91-generic", "4.19.0", "6.8.0-rc1+", "6.6.0-rc5+",
            "5.4.0-150-generic", "6.12.3", "5.19.17-1", "4.9.0"]
LOG_FUNCTIONS = ["ext4_writepages", "tcp_sendmsg", "kmem_cache_alloc", "blk_mq_start_request",
                 "netif_receive_skb", "do_page_fault", "rcu_core", "usb_submit_urb",
                 "bpf_prog_run", "kvm_vcpu_ioctl", "vfs_write"]
LOGS = [
    # null dereference with time stamps, two trace blocks
    "[  123.456001] BUG: unable to handle kernel NULL pointer dereference at {addr}\n"
    "[  123.456003] PGD 0 P4D 0\n[  123.456004] Oops: 0000 [#1] SMP NOPTI\n"
    "[  123.456005] CPU: 1 PID: 3456 Comm: udevd Tainted: G        W  {ver} #1\n"
    "[  123.456008] RIP: 0010:{fn}+0x45/0x200 [drv]\n[  123.456018] Call Trace:\n"
    "[  123.456019]  <TASK>\n[  123.456020]  {fn}+0x45/0x200\n[  123.456021]  {fn2}+0x321/0x600\n"
    "[  123.456022]  ret_from_fork+0x22/0x30\n[  123.456023]  </TASK>\n"
    "[  123.456024]  late_frame+0x1/0x2\n[  123.456025] CR2: {addr}",
    # use after free
    "==================================================================\n"
    "BUG: KASAN: use-after-free in {fn}+0x8e/0x1f0\nRead of size 8 at addr {addr} by task kworker\n\n"
    "CPU: 1 PID: 2345 Comm: kworker/1:2 Not tainted {ver} #1\nWorkqueue: events kfree_rcu_work\n"
    "Call Trace:\n <IRQ>\n dump_stack_lvl+0x48/0x70\n kasan_report+0xc8/0x100\n {fn}+0x8e/0x1f0\n"
    " {fn2}+0x7c/0x1b0\n kfree+0x10/0x20\n\nThe buggy address belongs to the object at {addr}",
    # lockdep report, no start marker
    "WARNING: possible circular locking dependency detected\n{ver} #1 Not tainted\n"
    "kworker/0:1/123 is trying to acquire lock:\n"
    "{addr} (&sb->s_type){+.+.}-{3:3}, at: {fn}+0x4c/0x1c0\n\n"
    "but task is already holding lock:\n       mutex_lock_nested+0x1b/0x30\n       {fn2}+0x4c/0x1c0",
    # soft lockup under the NMI watchdog
    "[  223.4567] NMI watchdog: BUG: soft lockup - CPU#3 stuck for 23s! [kworker/3:1:1234]\n"
    "[  223.4568] Modules linked in: nf_conntrack bridge\n[  223.4569] Linux version {ver} (gcc)\n"
    "[  223.4570] RIP: 0010:native_queued_spin_lock_slowpath+0x1a2/0x1e0\n[  223.4571] Call Trace:\n"
    "[  223.4572]  <IRQ>\n[  223.4573]  _raw_spin_lock_irqsave+0x3b/0x50\n"
    "[  223.4574]  try_to_wake_up+0x2a1/0x5e0\n[  223.4575]  {fn}+0x36/0x70\n"
    "[  223.4576]  </IRQ>\n[  223.4577]  {fn2}+0x1/0x2",
    # list corruption
    "list_del corruption. prev->next should be {addr}, but was dead000000000100 (LIST_POISON1)\n"
    "------------[ cut here ]------------\nkernel BUG at lib/list_debug.c:56!\n"
    "evil_mod: loading out-of-tree module taints kernel.\nCall Trace:\n <TASK>\n"
    " __list_del_entry+0x12/0x20\n {fn}+0x20c/0x400\n worker_thread+0x50/0x3e0\n </TASK>\n"
    "---[ end trace 0000000000000000 ]---\nKernel panic - not syncing: Fatal exception",
    # out of memory
    "kworker/2:0 invoked oom-killer: gfp_mask=0x140cca, order=0\n"
    "CPU: 2 PID: 4567 Comm: kworker/2:0 Tainted: P  {ver} #1\nCall Trace:\n dump_header+0x4c/0x220\n"
    " oom_kill_process+0x89/0x120\n out_of_memory+0x23c/0x510\n {fn}+0x8f7/0xbc0\n\nMem-Info:\n"
    "Out of memory: Killed process 8901 (myapp) total-vm:1048576kB\n"
    "Kernel panic - not syncing: Out of memory and no killable processes",
    # hung task
    "INFO: task kworker/u8:2 blocked for more than 120 seconds.\n      Tainted: G  OE  {ver} #167\n"
    "Call Trace:\n __schedule+0x2e3/0x740\n schedule+0x42/0xb0\n io_schedule+0x16/0x40\n"
    " {fn}+0x101/0x240\n mutex_lock+0x2c/0x40\n\n ? {fn2}+0x5/0x10",
    # rcu stall
    "INFO: rcu_sched self-detected stall on CPU\n\t3-....: (5250 ticks this GP)\nKernel: {ver} x86_64\n"
    "Call Trace:\n <IRQ>\n rcu_core+0x1a/0x50\n rcu_read_lock+0x9/0x10\n {fn}+0x1d/0x30\n"
    "Code: Bad RIP value.\n {fn2}+0x1/0x2",
    # slab out of bounds, address frames
    "BUG: KASAN: slab-out-of-bounds Write in {fn}+0x10/0x90\nLinux version {ver}\nBacktrace:\n"
    "[<ffffffff81001234>] {fn}+0x10/0x90\n[<ffffffff81001299>] {fn2}+0x22/0x44\nend of report",
    # refcount warning
    "WARNING: CPU: 0 PID: 1 at lib/refcount.c:28\nrefcount_t: underflow; use-after-free.\n"
    "RIP: 0010:refcount_warn_saturate+0xa6/0xf0\nStack trace:\n\n {fn}+0x1/0x2",
    # general protection fault
    "general protection fault: 0000 [#1] PREEMPT SMP\nCPU: 0 Comm: bash Tainted: G  {ver} #9\n"
    "RIP: 0010:{fn}+0x30/0x80\nCall trace:\n {fn}+0x30/0x80\n {fn2}+0x99/0xaa\nCode: 48 8b 07 0f",
    # paging request with virtual address
    "Unable to handle kernel paging request at virtual address {addr}\n#PF: error_code(0x0002) - not-present\n"
    "Internal error: Oops: 96000004 [#1] SMP\nCPU: 3 Comm: cat Tainted: G  {ver} #2\nCall trace:\n"
    " {fn}+0x10/0x20\n {fn2}+0x30/0x40\n el0_svc+0x8/0xc",
    # double free with slab BUG
    "BUG: KASAN: double-free or invalid free in {fn}+0x11/0x22\nkernel BUG at mm/slub.c:305!\n"
    "Linux version {ver} (builder)\nCall Trace:\n kfree+0x11/0x22\n {fn}+0x11/0x22",
    # interrupt storm and divide error
    "irq 19: nobody cared (try booting with irqpoll)\ndivide error: 0000 [#2] SMP\n"
    "UBSAN: shift-out-of-bounds in drivers/x.c:12\nhandlers:\n {fn}+0x1/0x2\nDisabling IRQ #19",
    # frames only: no panic line
    "trace follows\n {fn}+0x10/0x20\n {fn2}+0x30/0x40\nKernel: {ver}",
    # nothing recognisable
    "hello world, nothing to see here\nregular shutdown of machine {ver}",
]


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(index: str, values: list[str]) -> str:
    """CASE over ``index`` (an integer expression in 0..n-1) choosing a literal."""
    arms = " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


def _div(expr: str, n: int) -> str:
    return f"CAST(floor(({expr}) / {n}) AS BIGINT)"


def _diff_text(plus: list[str], minus: list[str]) -> str:
    lines = ["--- a/{file}", "+++ b/{file}", "@@ -1,4 +1,6 @@", "int probe_one(struct dev *d)",
             " = setup(d);", " \tcontext();"]
    return "\n".join(lines + ["-" + m for m in minus] + ["+" + p for p in plus])


_FN = pick("(doc_id * 7) % 11", FUNCTIONS)
_FN2 = pick("(doc_id * 5 + 3) % 11", FUNCTIONS)
_FOLDER = pick("doc_id % 13", FOLDERS)
_PHRASE = pick(f"{_div('doc_id', 13)} % 16", PHRASES)
_SUBJECT = (f"CASE WHEN doc_id % 17 = 0 THEN concat('Fix ', {_PHRASE}) ELSE concat("
            f"{pick('doc_id % 13', PREFIXES)}, ': fix ', {_PHRASE}, ' in ', {_FN}, '()') END")
_DAY = "CAST(DATE '2016-09-01' + CAST((doc_id * 37) % 3100 AS INT) AS STRING)"
_FILE = f"concat({_FOLDER}, '/', {_FN}, '.c')"

COMMIT_COLUMNS = [
    ("doc_id", "doc_id"),
    ("pos", "doc_id"),
    ("commit_hash", "CASE WHEN doc_id % 101 = 100 THEN '' ELSE md5(CAST(doc_id - "
                    "CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 0 END AS STRING)) END"),
    ("author", pick("doc_id % 4", ["Jane Roe", "Max Doe", "kim lee", "Äda Öz"])),
    ("email", pick("doc_id % 3", ["jane@example.org", "MAX@Example.org", "kim@example.net"])),
    ("date", f"CASE WHEN doc_id % 97 = 96 THEN 'not-a-date' WHEN doc_id % 89 = 88 THEN '2022-12-11' "
             f"ELSE {_DAY} END"),
    ("committer_date", f"CASE WHEN doc_id % 19 = 0 THEN NULL ELSE concat({_DAY}, ' 08:00:00') END"),
    ("subject", _SUBJECT),
    ("body", f"concat({_SUBJECT}, '\n\n', text, '\n', {pick('doc_id % 6', TRAILERS)})"),
    ("files_changed", f"CASE WHEN doc_id % 23 = 0 THEN {{arr}}() WHEN doc_id % 2 = 0 THEN {{arr}}({_FILE}) "
                      f"ELSE {{arr}}({_FILE}, 'include/linux/core.h', 'MAINTAINERS') END"),
    ("diff", f"CASE WHEN doc_id % 26 = 25 THEN NULL ELSE replace("
             f"{pick('doc_id % 26', [_diff_text(*d) for d in DIFFS])}, '{{file}}', {_FILE}) END"),
    ("insertions", "CAST(doc_id % 311 AS BIGINT)"),
    ("deletions", "CAST(doc_id % 97 AS BIGINT)"),
    ("is_merge", "doc_id % 31 = 0"),
    ("complexity", "CAST((doc_id * 3) % 70 AS BIGINT)"),
    ("methods", f"CASE WHEN doc_id % 3 = 0 THEN {{arr}}({_FN}, {_FN2}, {_FN}) ELSE {{arr}}() END"),
    ("parsed_added", "CASE WHEN doc_id % 11 = 0 THEN {arr}('\tput_page(page);') ELSE {arr}() END"),
]

CRASH_COLUMNS = [
    ("crash_id", "event_id"),
    ("name", "concat('log-', CAST(event_id AS STRING))"),
    ("content", "concat('session-', coalesce(CAST(user_id AS STRING), ''), ': ', coalesce(event_type, ''), ' ', coalesce(props, ''), chr(10), "
                "replace(replace(replace(replace("
                + pick("event_id % 16", LOGS)
                + f", '{{ver}}', {pick('(event_id * 5) % 9', VERSIONS)})"
                + f", '{{fn2}}', {pick('(event_id * 3 + 1) % 11', LOG_FUNCTIONS)})"
                + f", '{{fn}}', {pick(_div('event_id', 16) + ' % 11', LOG_FUNCTIONS)})"
                + ", '{addr}', "
                + pick("event_id % 4", ["0000000000000028", "ffff8881045a3c00", "dead000000000122",
                                        "0000000000000000"]) + "))"),
]

# Memory-dump features arrive pre-extracted, one row per order.
DUMP_COLUMNS = [
    ("crash_id", "o_orderkey"),
    ("dump_trace", "CASE o_orderkey % 5 WHEN 0 THEN {arr}('__mutex_lock_slowpath+0x1', 'vfs_write+0x2') "
                   "WHEN 1 THEN {arr}('kfree+0x3', 'tcp_sendmsg+0x1') WHEN 2 THEN {arr}('foo+0x1') "
                   "WHEN 3 THEN {arr}('nvme_queue_rq+0x9') ELSE {arr}() END"),
    ("dump_version", "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('6.', CAST(o_orderkey % 12 AS STRING), "
                     "'.0') END"),
    ("dump_modules", "CASE WHEN o_orderkey % 2 = 0 THEN {arr}('evil_mod', 'zfs') ELSE {arr}() END"),
    ("dump_panic", "CASE WHEN o_orderkey % 7 = 0 THEN 'sysrq triggered crash' ELSE '' END"),
]

# Model answers, one per conversation turn; the turn's whole text is quoted inside.
_SAFE = "replace(replace(replace(text, '\"', ' '), chr(92), ' '), chr(10), ' ')"
# A turn's text as the content of a JSON string.
QUOTED = "replace(replace(replace(replace(replace(coalesce(text, ''), '\"', ' '), chr(92), ' '), chr(10), ' '), chr(9), ' '), chr(13), ' ')"
_OBJ = ("concat('{\"subsystem\": \"', " + pick("conv_id % 4", ["net", "mm", "warp", "unknown"])
        + ", '\", \"bug_type\": \"', " + pick("turn % 3", ["deadlock", "gremlin", "use_after_free"])
        + ", '\", \"severity\": \"', " + pick("(conv_id + turn) % 3", ["high", "HIGH", "low"])
        + ", '\", \"confidence\": ', " + pick("conv_id % 5", ["0.2", "0.5", "0.95", "1.7", "-1"])
        + f", ', \"root_cause_hypothesis\": \"', {_SAFE}, '\"}}')")
ANSWER_COLUMNS = [
    ("conv_id", "conv_id"), ("turn", "turn"),
    ("answer", f"CASE (conv_id * 3 + turn) % 5 WHEN 0 THEN {_OBJ} "
               f"WHEN 1 THEN concat('Here you go:\n```json\n', {_OBJ}, '\n```\ndone') "
               f"WHEN 2 THEN concat('I think ', {_OBJ}, ' is right') "
               f"WHEN 3 THEN concat('no idea: ', text) ELSE concat('{{broken ', {_OBJ}) END"),
]


def _view(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    return spread(df).selectExpr(*[f"{e.replace('{arr}', 'array')} AS {n}" for n, e in columns])


def ansi_view(columns: list[tuple[str, str]], table: str) -> str:
    """The same view as an ANSI SELECT (list constructor ``list_value``)."""
    cols = ", ".join(f"{e.replace('{arr}', 'list_value')} AS {n}" for n, e in columns)
    return f"SELECT {cols} FROM {table}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per document, in the input schema of :mod:`faultline.operators.commits`."""
    base = _view(table(spark, sf_dir, "documents"), COMMIT_COLUMNS)
    change = F.struct(F.get("files_changed", 0).alias("filename"), "complexity", "methods",
                      F.col("parsed_added").alias("diff_parsed_added"),
                      F.col("insertions").alias("added_lines"), F.col("deletions").alias("deleted_lines"))
    return (base.withColumn("file_changes", F.when(F.size("files_changed") > 0, F.array(change)))
            .withColumnRenamed("diff", "diff_content").drop("complexity", "methods", "parsed_added"))


def crashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(table(spark, sf_dir, "events"), CRASH_COLUMNS)


def dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(table(spark, sf_dir, "orders"), DUMP_COLUMNS)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(table(spark, sf_dir, "conversations"), ANSWER_COLUMNS)
