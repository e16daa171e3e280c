"""Knowledge tables: bug patterns, lock rules, subsystem graph, filter maps.

FIXED VALUES: names, lists and relations that must be reproduced verbatim for
equal results.
"""

# bug type -> name, severity, category, symptoms, causes, fixes, keywords, tools, subsystems
BUG_PATTERNS = {
    "use_after_free": dict(
        name="Use-After-Free (UAF)", severity="CRITICAL", category="memory",
        symptoms=["KASAN: use-after-free in ...",
                  "list_del corruption / list_add corruption (freed object still on list)",
                  "slab poisoning detected", "use-after-free Write/Read in kmalloc-xxx",
                  "GPF (General Protection Fault) at freed address"],
        fixes=["Add refcount (kref_get/kref_put) before use",
               "Add RCU grace period (synchronize_rcu) before free",
               "Move kfree to release callback", "Add proper locking around object lifecycle",
               "Use kfree_rcu instead of kfree for RCU-protected objects"],
        keywords=["use after free", "kfree", "dangling pointer", "kref_get", "kref_put",
                  "synchronize_rcu", "kfree_rcu", "refcount_inc", "refcount_dec"],
        tools=["KASAN", "SLUB_DEBUG", "KFENCE"],
        subsystems=["mm", "net", "fs", "kernel", "rcu"]),
    "deadlock": dict(
        name="Deadlock (Spinlock/Mutex)", severity="HIGH", category="concurrency",
        symptoms=["NMI watchdog: BUG: soft lockup - CPU stuck",
                  "INFO: task xxx blocked for more than N seconds",
                  "lockdep splat: possible circular locking dependency detected",
                  "spin_lock already locked by ...", "Hung task detector: blocked tasks"],
        fixes=["Fix lock ordering (consistent acquisition order)",
               "Use spin_lock_irqsave in interrupt context",
               "Replace spin_lock with mutex if sleeping is needed",
               "Add lockdep annotations for correct ordering",
               "Reduce critical section size (lock hold time)"],
        keywords=["deadlock", "spin_lock", "mutex_lock", "lock ordering", "lockdep",
                  "circular locking", "ABBA", "spin_lock_irqsave", "spin_unlock_irqrestore"],
        tools=["LOCKDEP", "LOCK_STAT", "NMI watchdog"],
        subsystems=["kernel", "mm", "fs", "net", "block", "drivers"]),
    "null_pointer": dict(
        name="NULL Pointer Dereference", severity="HIGH", category="memory",
        symptoms=["BUG: unable to handle kernel NULL pointer dereference at 0x00000000",
                  "Oops: 0000 [#1] SMP",
                  "Unable to handle kernel paging request at virtual address 0x00000000",
                  "RIP: some_function+N/m"],
        fixes=["Add NULL pointer check before dereference",
               "Add error handling for allocation failures",
               "Use ERR_PTR/IS_ERR for error propagation", "Initialize data structures before use",
               "Add proper locking for pointer updates"],
        keywords=["NULL pointer", "null dereference", "null check", "IS_ERR", "ERR_PTR", "PTR_ERR",
                  "if (!ptr)", "if (IS_ERR_OR_NULL"],
        tools=["KASAN", "UBSAN", "SMAP"], subsystems=["kernel", "drivers", "mm", "fs", "net"]),
    "race_condition": dict(
        name="Race Condition / Data Race", severity="HIGH", category="concurrency",
        symptoms=["Intermittent crash / data corruption under load", "KCSAN: data-race in ...",
                  "lockdep: inconsistent lock state", "RCU stall due to missing synchronization",
                  "Counter / statistic mismatch under concurrent access"],
        fixes=["Add spinlock/mutex around critical sections",
               "Use atomic operations (atomic_inc/dec/read)",
               "Add memory barriers (smp_mb, smp_wmb, smp_rmb)",
               "Use RCU APIs correctly (rcu_read_lock/rcu_assign_pointer)",
               "Use WRITE_ONCE/READ_ONCE for shared variables"],
        keywords=["race condition", "data race", "concurrent", "spin_lock", "atomic_inc",
                  "atomic_read", "rcu_read_lock", "synchronize_rcu", "smp_mb", "WRITE_ONCE",
                  "READ_ONCE", "memory barrier"],
        tools=["KCSAN", "LOCKDEP", "syzkaller"],
        subsystems=["kernel", "mm", "net", "fs", "drivers"]),
    "buffer_overflow": dict(
        name="Buffer Overflow / Out-of-Bounds", severity="CRITICAL", category="memory",
        symptoms=["KASAN: slab-out-of-bounds Write/Read in ...", "KASAN: stack-out-of-bounds in ...",
                  "KASAN: global-out-of-bounds in ...", "fortify: detected buffer overflow",
                  "PaX: size overflow detected"],
        fixes=["Add bounds checking before copy/write", "Replace strcpy with strscpy/strlcpy",
               "Replace sprintf with snprintf/scnprintf",
               "Validate user-supplied length against buffer size",
               "Use flex arrays instead of fixed-size arrays"],
        keywords=["buffer overflow", "out of bounds", "strscpy", "snprintf", "bounds check",
                  "overflow", "off by one", "strncpy", "memcpy"],
        tools=["KASAN", "FORTIFY_SOURCE", "UBSAN"], subsystems=["fs", "net", "drivers", "kernel"]),
    "memory_leak": dict(
        name="Memory Leak", severity="MEDIUM", category="memory",
        symptoms=["kmemleak: unreferenced object ...", "kmalloc-xxx: memory leak detected",
                  "Slow memory growth over time (OOM after days of uptime)",
                  "slabtop showing unusual slab growth",
                  "/proc/meminfo showing increasing SUnreclaim"],
        fixes=["Add missing kfree/put in error paths", "Use goto-based error unwinding for cleanup",
               "Add __must_check annotation to allocation functions",
               "Use devm_* (managed) allocations in drivers",
               "Add leak detection assertions in module exit"],
        keywords=["memory leak", "kmemleak", "kfree", "missing free", "resource leak", "unfreed",
                  "goto", "error path", "cleanup"],
        tools=["KMEMLEAK", "KASAN", "slabtop"], subsystems=["mm", "net", "fs", "drivers"]),
    "double_free": dict(
        name="Double Free", severity="CRITICAL", category="memory",
        symptoms=["KASAN: double-free in kmalloc-xxx", "slab: double free detected in cache 'xxx'",
                  "kernel BUG at mm/slub.c:xxx", "list_del corruption (freed object still on list)",
                  "Poison overwritten (freed memory was modified)"],
        fixes=["Set pointer to NULL after kfree", "Add proper refcounting before free",
               "Add locking for kfree paths", "Centralize free in destructor function",
               "Check for NULL before kfree (defensive)"],
        keywords=["double free", "double-free", "kfree(NULL)", "refcount_dec_and_test", "kref_put",
                  "pointer NULL after free", "kzfree"],
        tools=["KASAN", "SLUB_DEBUG", "KFENCE"], subsystems=["mm", "net", "drivers"]),
    "rcu_stall": dict(
        name="RCU Stall / Grace Period Stall", severity="HIGH", category="concurrency",
        symptoms=["INFO: rcu_sched detected stalls on CPUs/tasks",
                  "rcu_preempt detected expedited stalls",
                  "Tasks blocked waiting for RCU grace period",
                  "System freeze during synchronize_rcu"],
        fixes=["Reduce RCU read-side critical section length",
               "Move heavy work outside rcu_read_lock/rcu_read_unlock",
               "Use call_rcu instead of synchronize_rcu where possible",
               "Add missing rcu_read_unlock in error paths",
               "Use rcu_barrier to drain pending callbacks"],
        keywords=["rcu stall", "synchronize_rcu", "call_rcu", "rcu_read_lock", "rcu_read_unlock",
                  "rcu_barrier", "rcu grace period", "rcu_expedited"],
        tools=["RCU_STALL", "PROVE_RCU", "lockdep"], subsystems=["rcu", "kernel", "mm", "net"]),
    "oom": dict(
        name="Out of Memory (OOM)", severity="CRITICAL", category="memory",
        symptoms=["Out of memory: Killed process ... (oom_score_adj=...",
                  "Kernel panic - not syncing: Out of memory and no killable processes",
                  "page allocation failure: order:N, mode:...",
                  "system almost out of memory during heavy reclaim"],
        fixes=["Fix memory leak in the leaking component",
               "Use __GFP_RETRY_MAYFAIL instead of __GFP_NORETRY", "Increase vm.min_free_kbytes",
               "Use kvmalloc for large allocations (fallback to vmalloc)",
               "Tune OOM killer / memory cgroup settings"],
        keywords=["out of memory", "OOM", "page allocation failure", "kvmalloc",
                  "__GFP_RETRY_MAYFAIL", "min_free_kbytes", "memory reclaim", "memory cgroup",
                  "vmalloc"],
        tools=["OOM killer", "kmemleak", "vmstat", "meminfo"], subsystems=["mm", "kernel"]),
    "stack_overflow": dict(
        name="Kernel Stack Overflow", severity="HIGH", category="memory",
        symptoms=["BUG: stack guard page was hit at ...", "Kernel stack overflow - potential crash",
                  "do_IRQ: stack overflow: ...", "Stack frame size > 2048 bytes warning"],
        fixes=["Move large variables from stack to heap (kmalloc)", "Convert recursion to iteration",
               "Increase CONFIG_FRAME_WARN to catch large frames",
               "Use kmalloc for large temporary buffers", "Optimize call chain depth"],
        keywords=["stack overflow", "stack guard", "kmalloc", "recursion", "on-stack", "large array",
                  "FRAME_WARN", "stack frame"],
        tools=["CONFIG_VMAP_STACK", "CONFIG_FRAME_WARN"], subsystems=["kernel", "fs", "mm"]),
}

# FIXED VALUES: common causes and kernel configuration options of each bug pattern.
COMMON_CAUSES = {
    "use_after_free": ["Race condition between kfree() and concurrent access", "Missing reference count increment before queuing work",
                       "Error path frees object while it's still in use", "RCU callback frees object but reader still holds RCU lock",
                       "Module unload frees memory still referenced by kernel"],
    "deadlock": ["ABBA deadlock: two locks acquired in different order", "Spinlock held during schedule()/sleep",
                 "Interrupt context acquires a lock already held by process context",
                 "Recursive lock acquisition (spin_lock on already held lock)", "Missing unlock on error path"],
    "null_pointer": ["Missing NULL check after allocation failure", "Function returns NULL on error but caller doesn't check",
                     "Data structure not yet initialized", "Race condition: pointer set to NULL while in use",
                     "kzalloc/kcalloc returning NULL under memory pressure"],
    "race_condition": ["Missing lock for shared data access", "Check-then-act race (TOCTOU - Time of Check to Time of Use)",
                       "Missing memory barrier between CPU writes", "Incorrect use of RCU (missing rcu_read_lock)",
                       "Per-CPU variable access without preemption disable"],
    "buffer_overflow": ["Off-by-one error in buffer size calculation", "Unbounded strcpy/strcat/sprintf usage",
                        "User-supplied length not validated", "Integer overflow in size calculation", "Missing bounds check on array index"],
    "memory_leak": ["Missing kfree on error path", "Forgetting to call put_*() after get_*()",
                    "Allocation in loop without corresponding free", "Module unload without freeing resources",
                    "Reference count leak (extra get without put)"],
    "double_free": ["Error path frees same object twice", "Concurrent kfree from two threads",
                    "Object freed by both release callback and caller", "Reference count drops below zero and object freed twice",
                    "Module use-after-free triggering false double-free detection"],
    "rcu_stall": ["RCU read-side critical section too long", "Preemption disabled while holding rcu_read_lock",
                  "synchronize_rcu called from non-sleepable context", "Missing rcu_read_unlock on error path",
                  "Too many call_rcu callbacks pending"],
    "oom": ["Genuine memory shortage (high memory pressure)", "Memory leak causing slow exhaustion",
            "High-order allocation failure under fragmentation", "Memory cgroup limit too low", "Slab cache growing unboundedly"],
    "stack_overflow": ["Deep recursion (e.g., nested filesystem operations)", "Large on-stack variables (arrays > 1KB)",
                       "Heavy function call chain (many small stack frames)", "Interrupt stacking on already-deep stack"],
}
KERNEL_OPTIONS = {
    "use_after_free": ["CONFIG_KASAN=y", "CONFIG_SLUB_DEBUG=y", "CONFIG_KFENCE=y"],
    "deadlock": ["CONFIG_PROVE_LOCKING=y", "CONFIG_DEBUG_LOCKDEP=y", "CONFIG_LOCK_STAT=y"],
    "null_pointer": ["CONFIG_KASAN=y", "CONFIG_UBSAN=y"],
    "race_condition": ["CONFIG_KCSAN=y", "CONFIG_PROVE_LOCKING=y"],
    "buffer_overflow": ["CONFIG_KASAN=y", "CONFIG_FORTIFY_SOURCE=y", "CONFIG_UBSAN_BOUNDS=y"],
    "memory_leak": ["CONFIG_DEBUG_KMEMLEAK=y", "CONFIG_DEBUG_KMEMLEAK_DEFAULT_OFF=n"],
    "double_free": ["CONFIG_KASAN=y", "CONFIG_SLUB_DEBUG=y"],
    "rcu_stall": ["CONFIG_PROVE_RCU=y", "CONFIG_RCU_CPU_STALL_TIMEOUT=60"],
    "oom": ["CONFIG_MEMCG=y", "CONFIG_COMPACTION=y"],
    "stack_overflow": ["CONFIG_VMAP_STACK=y", "CONFIG_FRAME_WARN=2048"],
}
for _name, _pattern in BUG_PATTERNS.items():
    _pattern.update(causes=COMMON_CAUSES[_name], options=KERNEL_OPTIONS[_name])
# FIXED VALUES: title and use of each lock type.
LOCK_TITLES = {
    "spinlock": ("自旋锁 (Spinlock)", "短临界区、中断上下文、不可睡眠"),
    "mutex": ("互斥锁 (Mutex)", "可能睡眠的临界区、进程上下文"),
    "rwsem": ("读写信号量 (R/W Semaphore)", "读多写少的场景、页表锁、文件系统锁"),
    "rcu": ("RCU (Read-Copy-Update)", "读频繁写稀少、指针更新保护"),
    "rwlock": ("读写自旋锁 (R/W Spinlock)", "读多写少 + 不可睡眠的短临界区"),
    "seqlock": ("顺序锁 (Seqlock)", "写非常稀少、读非常频繁 (如 jiffies, timekeeping)"),
}
LOCK_APIS = [
    ("spinlock", ["spin_lock", "spin_unlock", "spin_lock_irq", "spin_unlock_irq",
                  "spin_lock_irqsave", "spin_unlock_irqrestore", "spin_lock_bh", "spin_unlock_bh",
                  "spin_trylock"]),
    ("mutex", ["mutex_lock", "mutex_unlock", "mutex_lock_interruptible", "mutex_lock_killable",
               "mutex_trylock", "mutex_is_locked"]),
    ("rwsem", ["down_read", "up_read", "down_write", "up_write", "down_read_trylock",
               "down_write_trylock", "downgrade_write"]),
    ("rcu", ["rcu_read_lock", "rcu_read_unlock", "synchronize_rcu", "synchronize_rcu_expedited",
             "call_rcu", "rcu_assign_pointer", "rcu_dereference", "rcu_barrier",
             "rcu_access_pointer"]),
    ("rwlock", ["read_lock", "read_unlock", "write_lock", "write_unlock", "read_lock_irqsave",
                "write_lock_irqsave", "read_lock_bh", "write_lock_bh"]),
    ("seqlock", ["write_seqlock", "write_sequnlock", "read_seqbegin", "read_seqretry",
                 "write_seqlock_irqsave", "write_sequnlock_irqrestore"]),
]
LOCK_ISSUES = [
    "持 spinlock 时可能调用了 sleepable 函数 (sleep-in-atomic)",
    "中断相关路径中使用 spin_lock 而非 spin_lock_irqsave",
    "rcu_read_lock 内调用了可能睡眠的函数",
]
# (id, description, subsystems)
LOCK_ORDERING = [
    ("L001", "先获取外层锁，再获取内层锁", ["mm"]),
    ("L002", "先 inode->i_mutex，再 file->f_lock", ["fs"]),
    ("L003", "先 socket lock，再 socket buffer lock", ["net"]),
    ("L004", "先 rcu_read_lock，再 spin_lock", ["kernel", "mm", "net", "fs"]),
    ("L005", "先 mutex，再 spinlock (进程上下文)", ["kernel"]),
    ("L006", "release 顺序: 先释放内层锁，再释放外层锁", ["kernel"]),
    ("L007", "中断上下文只能使用 spin_lock_irqsave，不能使用 mutex", ["kernel", "drivers"]),
    ("L008", "page fault 路径中避免获取 mmap_sem 外的其他锁", ["mm", "fs"]),
]
# (name, lockdep message, generic needle or None)
DEADLOCK_PATTERNS = [
    ("ABBA Deadlock", "possible circular locking dependency detected", "circular locking"),
    ("Recursive Lock", "possible recursive locking detected", "recursive locking"),
    ("Interrupt Deadlock", "possible irq lock inversion dependency detected", "irq lock inversion"),
    ("Sleep-in-Atomic", "sleeping function called from invalid context",
     "sleeping function called from invalid context"),
    ("Lock Inversion", "possible irq lock inversion dependency detected", None),
]
LOCK_FIXES = {
    "add_spinlock": "添加 spin_lock/spin_unlock 保护共享数据访问",
    "add_spinlock_irqsave": "在可能被中断访问的数据路径中使用 spin_lock_irqsave",
    "add_mutex": "在可能睡眠的临界区使用 mutex_lock/mutex_unlock",
    "add_rcu": "使用 RCU 保护读多写少的指针型共享数据",
    "fix_ordering": "修正锁获取顺序，确保所有路径使用相同顺序",
    "reduce_critical_section": "缩小临界区，将非关键操作移到锁外",
    "convert_to_atomic": "对简单共享变量使用 atomic_t 代替锁",
    "add_rcu_dereference": "添加 rcu_dereference/rcu_dereference_protected 保护 RCU 指针访问",
}
LOCK_FIX_DEFAULT = "未知锁修复模式"

# (subsystem, title, path prefixes, key functions, related bug types)
SUBSYSTEMS = [
    ("mm", "Memory Management", ["mm/", "include/linux/mm.h", "include/linux/slab.h"],
     ["kmalloc", "kfree", "kzalloc", "vmalloc", "vfree", "__get_free_pages", "free_pages",
      "alloc_pages", "kmem_cache_alloc", "kmem_cache_free", "kref_get", "kref_put", "kref_init"],
     ["use_after_free", "null_pointer", "double_free", "memory_leak", "memory_corruption",
      "out_of_bound"]),
    ("fs", "File Systems / VFS", ["fs/", "include/linux/fs.h"],
     ["vfs_read", "vfs_write", "d_alloc", "d_instantiate", "iget_locked", "iput", "dput", "mntget",
      "file_open", "filp_close", "sync_filesystem"],
     ["deadlock", "race_condition", "use_after_free", "buffer_overflow", "null_pointer", "hang"]),
    ("net", "Networking", ["net/", "include/net/", "include/linux/netdevice.h"],
     ["sock_create", "sock_release", "tcp_sendmsg", "tcp_recvmsg", "dev_queue_xmit", "netif_rx",
      "skb_get", "kfree_skb", "dev_alloc_skb", "skb_queue_tail", "__netif_receive_skb"],
     ["use_after_free", "race_condition", "memory_leak", "null_pointer", "deadlock",
      "buffer_overflow"]),
    ("block", "Block Layer", ["block/", "include/linux/blkdev.h"],
     ["bio_alloc", "bio_add_page", "submit_bio", "blk_mq_start_request", "blk_mq_end_request",
      "blk_get_request", "blk_put_request"],
     ["deadlock", "race_condition", "memory_leak", "use_after_free", "hang"]),
    ("kernel", "Core Kernel", ["kernel/", "include/linux/sched.h"],
     ["schedule", "wake_up_process", "do_exit", "spin_lock", "mutex_lock", "rcu_read_lock",
      "synchronize_rcu", "call_rcu", "add_timer", "del_timer", "mod_timer"],
     ["deadlock", "race_condition", "rcu_stall", "hang", "crash"]),
    ("drivers", "Device Drivers", ["drivers/"],
     ["driver_register", "driver_unregister", "probe", "remove", "suspend", "resume"],
     ["null_pointer", "use_after_free", "memory_leak", "race_condition", "crash"]),
    ("arch", "Architecture-Specific", ["arch/"],
     ["do_page_fault", "handle_mm_fault", "syscall_init", "trap_init"],
     ["crash", "null_pointer", "buffer_overflow"]),
    ("bpf", "BPF / eBPF", ["kernel/bpf/", "include/linux/bpf.h", "include/uapi/linux/bpf.h"],
     ["bpf_prog_alloc", "bpf_prog_free", "bpf_map_lookup_elem", "bpf_map_update_elem",
      "__bpf_call_base"],
     ["use_after_free", "race_condition", "null_pointer", "out_of_bound", "memory_leak"]),
    ("security", "Security / LSMs",
     ["security/", "include/linux/lsm_hooks.h", "include/linux/security.h"],
     ["security_inode_permission", "security_file_ioctl", "selinux_inode_setattr",
      "apparmor_file_open"],
     ["null_pointer", "use_after_free", "memory_leak"]),
    ("kvm", "KVM Virtualization", ["virt/kvm/", "arch/x86/kvm/", "arch/arm64/kvm/"],
     ["kvm_vcpu_ioctl", "kvm_mmu_page_fault", "kvm_arch_vcpu_ioctl_run", "kvm_mmu_free_page"],
     ["use_after_free", "null_pointer", "race_condition"]),
    ("rcu", "RCU Subsystem", ["kernel/rcu/", "include/linux/rcupdate.h"],
     ["rcu_read_lock", "rcu_read_unlock", "synchronize_rcu", "call_rcu", "rcu_barrier",
      "rcu_assign_pointer", "rcu_dereference"],
     ["rcu_stall", "race_condition", "use_after_free", "hang"]),
    ("cgroup", "Control Groups", ["kernel/cgroup/", "include/linux/cgroup.h"],
     ["cgroup_init", "cgroup_exit", "css_get", "css_put", "cgroup_add_file"],
     ["deadlock", "race_condition", "memory_leak", "use_after_free"]),
]
GRAPH_HIERARCHY = {
    "kernel": ["rcu", "cgroup", "bpf", "irq"],
    "drivers": ["usb", "pci", "nvme", "scsi", "net"],
    "drivers/net": ["ethernet", "wireless", "bluetooth"],
    "fs": ["nfs", "ext4", "btrfs", "xfs"],
    "arch": ["kvm"],
    "security": ["crypto"],
    "mm": ["slab", "page_alloc", "swap", "compaction"],
}
GRAPH_COUPLED = {
    "mm": ["fs", "block", "kernel", "arch"],
    "fs": ["mm", "block", "kernel", "security"],
    "net": ["kernel", "bpf", "drivers", "cgroup"],
    "block": ["mm", "fs", "drivers", "scsi", "nvme"],
    "kernel": ["mm", "rcu", "cgroup", "bpf", "irq", "arch"],
    "drivers": ["kernel", "arch", "mm", "net"],
    "rcu": ["kernel", "mm", "net"],
    "bpf": ["net", "kernel", "security"],
    "kvm": ["arch", "mm", "kernel"],
    "cgroup": ["mm", "kernel", "net"],
    "security": ["fs", "kernel", "net", "arch"],
}
GRAPH_CALLS = {
    "fs": ["mm", "block", "security"],
    "net": ["mm", "kernel"],
    "block": ["mm", "kernel"],
    "drivers": ["mm", "kernel", "arch"],
    "kvm": ["mm", "kernel", "arch"],
    "bpf": ["kernel", "net"],
}

# Filter relations.
FILTER_HIERARCHY = {"kernel": ["rcu", "cgroup", "bpf", "irq"], "drivers": ["usb", "pci", "nvme", "scsi"],
                    "fs": ["nfs"], "arch": ["kvm"]}
FILTER_RELATED = {
    "mm": ["fs", "block", "kernel"],
    "net": ["drivers", "kernel", "bpf"],
    "fs": ["mm", "block", "kernel", "nfs"],
    "block": ["mm", "fs", "drivers", "scsi", "nvme"],
    "deadlock": ["kernel", "mm", "fs", "net", "block"],
}
BUG_TYPE_GROUPS = {
    "use_after_free": ["use_after_free", "double_free", "memory_corruption"],
    "null_pointer": ["null_pointer", "crash"],
    "deadlock": ["deadlock", "hang", "concurrency"],
    "race_condition": ["race_condition", "concurrency", "deadlock"],
    "memory_leak": ["memory_leak", "resource_leak"],
    "buffer_overflow": ["buffer_overflow", "out_of_bound"],
    "hang": ["hang", "deadlock", "concurrency"],
    "crash": ["crash", "null_pointer"],
    "security": ["security"],
}

# Fusion weights.
FUSION_WEIGHTS = (0.2, 0.4, 0.4)
DISPLAY_WEIGHTS = {"embedding": 0.15, "reranker": 0.25, "expert_rule": 0.15, "callstack_match": 0.10,
                   "subsystem_match": 0.10, "version_match": 0.10, "llm_judge": 0.15}

# FIXED VALUES: suffixes and texts of a patch's ranking reasons (subsystem, bug type, call path, stable tag).
PATCH_REASONS = ("子系统一致", "一致", "调用路径一致", "Cc: stable 标记")

# FIXED VALUES: search words that a fix seen in the diff adds to the inferred ones.
DIFF_EVIDENCE_WORDS = {
    "lock": ["spin_lock", "mutex_lock", "lock_irqsave"],
    "refcount": ["kref_get", "kref_put", "refcount_inc", "refcount_dec"],
    "rcu": ["kfree_rcu", "synchronize_rcu", "rcu_read_lock", "rcu_read_unlock"],
}
