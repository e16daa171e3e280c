"""Commit root-cause templates and diff rules.

FIXED VALUES: labels, sentences and pattern lists that must be reproduced
verbatim for equal results.  Rule order breaks score ties.
"""

# bug_type -> (root cause, severity, typical fix, {subsystem: root cause})
BUG_TEMPLATES = {
    "null_pointer": (
        "Missing NULL validation — dereferencing uninitialized or failed-alloc pointer", 8,
        "Add NULL check or error handling path before dereference",
        {"drivers": "Driver probe error path missing NULL check after resource allocation",
         "fs": "Failed inode/dentry allocation not handled",
         "mm": "Page allocation failure path not guarded with NULL check",
         "net": "Socket buffer allocation failure not checked"}),
    "use_after_free": (
        "Object lifetime violation — memory accessed after deallocation", 9,
        "Add reference counting (kref_get/kref_put) or RCU delayed free (kfree_rcu)",
        {"mm": "Slab/Slub object lifecycle error in memory allocator path",
         "net": "Socket buffer or network packet lifecycle error after kfree_skb",
         "fs": "Inode/dentry cache lifecycle error after dput/iput",
         "drivers": "Device driver object freed while still referenced by workqueue or timer",
         "block": "Block IO request freed while still in flight"}),
    "double_free": (
        "Duplicate deallocation — same memory region freed twice", 9,
        "NULL pointer after kfree, or reference count guard before free",
        {"mm": "Slab double-free in memory management path",
         "net": "Double kfree_skb or duplicate packet free",
         "drivers": "Double put_device or double free_irq"}),
    "buffer_overflow": (
        "Buffer boundary violation — write exceeds allocated buffer size", 8,
        "Replace strcpy/strcat with strscpy, or add size/bounds validation",
        {"fs": "Pathname buffer overflow in filesystem operations",
         "net": "Network packet parsing buffer overflow",
         "drivers": "Firmware or configuration buffer overflow in driver"}),
    "out_of_bound": (
        "Array index out of bounds — index exceeds allocated range", 9,
        "Add bounds check before array access or use array_index_nospec", {}),
    "memory_corruption": (
        "Memory integrity violation — stale pointer, race condition, or buffer overflow causing data "
        "corruption", 8,
        "Add proper synchronization (spin_lock/mutex) or fix pointer lifecycle",
        {"mm": "Linked list corruption (list_del/list_add) in memory management structures",
         "net": "Network buffer corruption from concurrent access or DMA sync issue",
         "fs": "Filesystem metadata corruption from race condition"}),
    "memory_leak": (
        "Resource release missing — allocated memory never freed on all exit/error paths", 7,
        "Add kfree/kref_put on error and cleanup goto paths", {}),
    "use_before_init": (
        "Resource used before initialization — ordering violation in initialization sequence", 7,
        "Reorder initialization or add dependency check before use",
        {"drivers": "Driver hardware accessed before probe() completes initialization",
         "kernel": "Subsystem notifier called before infrastructure is ready"}),
    "uninitialized": (
        "Uninitialized variable or structure field used before assignment", 7,
        "Initialize variable/structure at declaration or before first use", {}),
    "stack_overflow": (
        "Kernel stack exhausted — excessive stack usage from recursion or large stack allocations", 9,
        "Move large buffer from stack to heap (kmalloc), eliminate recursion, or use CONFIG_FRAME_WARN",
        {"fs": "Deep filesystem recursion exhausting 8KB/16KB kernel stack",
         "drivers": "Large on-stack DMA descriptor or configuration structure"}),
    "deadlock": (
        "Lock ordering violation or circular dependency causing task hang", 9,
        "Reorder lock acquisition, reduce lock granularity, or use try_lock with fallback",
        {"mm": "Memory reclaim lock inversion (mmap_sem vs i_mutex)",
         "fs": "Filesystem lock ordering violation (i_mutex vs internal fs lock)",
         "block": "Block layer queue lock vs IO scheduler lock inversion",
         "drivers": "Driver spinlock held across scheduling point without irqsave",
         "net": "Network stack lock ordering between socket lock and device lock"}),
    "race_condition": (
        "Concurrent access without proper synchronization — data race between threads/IRQs", 8,
        "Add spin_lock/mutex protection or use atomic operations (atomic_inc/atomic_cmpxchg)",
        {"drivers": "Interrupt handler and process context race on device registers",
         "net": "Concurrent socket operations without lock_sock",
         "fs": "Parallel filesystem operations on shared inode without exclusion"}),
    "hang": (
        "Task or CPU stalled — infinite loop, lost wakeup, or I/O blockage", 8,
        "Add cond_resched(), schedule_timeout, or fix wakeup condition",
        {"block": "Block IO hang — request indefinitely stuck in queue",
         "fs": "NFS/RPC hang — remote server unresponsive, no timeout",
         "kernel": "Hardlockup or hungtask in scheduler or interrupt path"}),
    "rcu_stall": (
        "RCU grace period stall — RCU read-side critical section too long or missing rcu_read_unlock", 8,
        "Shorten RCU read section, add cond_resched(), or fix missing rcu_read_unlock",
        {"kernel": "RCU callback processing blocked by long-running RCU reader",
         "net": "Network packet processing in RCU read section without resched point"}),
    "soft_lockup": (
        "Soft lockup — CPU stuck in kernel mode for too long without yielding", 8,
        "Add cond_resched() in long loops, reduce lock hold time, or fix infinite loop condition", {}),
    "oom": (
        "Out of memory — system exhausted all available memory including swap", 7,
        "Fix memory leak, limit cgroup memory, or optimize memory reclaim/reuse",
        {"mm": "Memory allocator leak or excessive slab cache consumption"}),
    "resource_leak": (
        "Resource not released — file, socket, IRQ, DMA, or hardware resource leaked", 6,
        "Add proper release (fput/sock_release/free_irq) on all exit and error paths",
        {"drivers": "IRQ or DMA channel not freed on driver unload/error",
         "fs": "File descriptor leak in error path",
         "net": "Socket leak in connection error handling"}),
    "security": (
        "Security vulnerability — exploitable memory access, privilege escalation, or information leak", 9,
        "Validate user input, restrict privileges, fix memory access boundaries", {}),
    "crash": (
        "Kernel crash — BUG_ON/WARN_ON/paging fault/GPF triggered by violated invariant", 8,
        "Fix the violated invariant condition or add defensive check before assertion", {}),
    "regression": (
        "Kernel regression — previously working functionality broken by recent change", 6,
        "Revert the introducing commit or fix the changed logic", {}),
    "performance": (
        "Performance degradation — suboptimal code path, excessive lock contention, or cache miss", 5,
        "Optimize algorithm, reduce lock contention, add caching, or batch operations", {}),
    "logic_error": (
        "Logic error — incorrect condition, calculation, state machine transition, or control flow", 7,
        "Fix the incorrect logic condition, state transition, or calculation", {}),
    "configuration": (
        "Configuration issue — incorrect Kconfig dependency, sysctl default, or device tree binding", 5,
        "Fix Kconfig dependency, correct default value, or update device tree", {}),
    "integer_overflow": (
        "Integer overflow or underflow in arithmetic, size calculation, or allocation", 8,
        "Use size_add/size_mul/size_sub or check for overflow before arithmetic operations", {}),
    "unknown": (
        "Undetermined root cause — insufficient structured information from Collector", 5,
        "Analyze commit message and diff content for manual diagnosis", {}),
}

# (name, required '+', required '-', optional '+', min optional hits, message hints,
#  root cause, fix pattern).  The required lists are OR gates.
DIFF_RULES = [
    ("L01", ["mutex_unlock(", "spin_unlock(", "up_write(", "up_read("], [], [], 0,
     ["deadlock", "lockup", "stall", "hung", "lock", "unlock"],
     "Missing lock release causing deadlock or hung task — unlock added on exit/error path",
     "lock release (unlock) added on exit or error path"),
    ("L02", ["spin_lock_irqsave(", "spin_lock_irq("], ["spin_lock("], [], 0,
     ["interrupt", "irq", "softirq", "deadlock", "hardlockup", "irqsave"],
     "Missing irqsave — spin_lock used in interrupt-capable context causes hardlockup",
     "spin_lock replaced with spin_lock_irqsave for interrupt safety"),
    ("L03", ["mutex_unlock(", "spin_unlock("], [],
     ["goto ", "return -E", "return -ENOMEM", "return -EINVAL"], 1,
     ["error path", "goto", "cleanup", "missing unlock", "leak"],
     "Missing lock release on error/cleanup goto path — lock held during error return",
     "lock release added on error goto cleanup path"),
    ("L04", ["cond_resched(", "schedule_timeout("], ["spin_lock("], ["spin_unlock("], 0,
     ["scheduling while atomic", "sleeping function", "might_sleep", "atomic context"],
     "Scheduling while atomic — spinlock held across sleep point or cond_resched",
     "lock released before scheduling point to avoid atomic sleep"),
    ("L05", ["mutex_trylock(", "spin_trylock("], ["mutex_lock(", "spin_lock("], [], 0,
     ["contention", "trylock", "try_lock", "stall", "hang", "deadlock"],
     "Lock contention causing stall — blocking lock converted to trylock with fallback",
     "blocking lock replaced with trylock to avoid stall"),
    ("L06", ["down_read(", "up_read("], ["down_write(", "up_write(", "mutex_lock("], [], 0,
     ["read", "write lock", "rwlock", "downgrade", "contention", "performance"],
     "Excessive exclusive lock for read-only path — write lock downgraded to read lock",
     "write lock downgraded to read lock for read-only access path"),
    ("L07", [], ["mutex_lock("], [], 0,
     ["double lock", "recursive lock", "already locked", "deadlock"],
     "Duplicate lock acquisition — same context locks mutex twice causing recursive deadlock",
     "duplicate mutex_lock call removed to prevent recursive locking"),
    ("L08", ["spin_lock(", "mutex_lock("], ["spin_lock(", "mutex_lock("], [], 0,
     ["lock order", "ABBA", "lockdep", "circular", "ordering", "inversion"],
     "Lock ordering violation — ABBA deadlock between two lock classes (lockdep detected)",
     "lock acquisition order corrected to prevent ABBA deadlock"),
    ("R01", ["kref_put(", "refcount_dec("], [], ["kref_put_and_test("], 0,
     ["leak", "refcount", "kref", "release", "put", "memory leak"],
     "Reference count leak — missing kref_put/refcount_dec on object release path",
     "reference count decrement (kref_put/refcount_dec) added on release path"),
    ("R02", ["kref_get(", "refcount_inc("], [], [], 0,
     ["use-after-free", "uaf", "kasan", "use after free"],
     "Use-after-free — object freed while still referenced, missing kref_get before use",
     "reference count increment (kref_get/refcount_inc) added to protect object lifetime"),
    ("R03", ["refcount_add_not_zero(", "refcount_inc_not_zero("], ["refcount_inc(", "refcount_add("],
     [], 0, ["overflow", "saturation", "refcount", "saturated"],
     "Reference count overflow — refcount_inc may overflow without saturation check",
     "safe refcount increment (refcount_inc_not_zero) used to prevent overflow"),
    ("R04", ["get_device(", "put_device("], [], [], 0,
     ["get", "put", "device", "refcount", "leak", "uaf"],
     "get/put pairing imbalance in device reference counting — lifecycle management error",
     "matched get_device/put_device pairing restored for device lifecycle"),
    ("C01", ["rcu_read_lock(", "rcu_read_unlock("], [], [], 0,
     ["use-after-free", "rcu", "uaf", "grace period", "rcu_dereference"],
     "RCU-protected pointer accessed without rcu_read_lock critical section",
     "RCU read-side critical section (rcu_read_lock/rcu_read_unlock) added"),
    ("C02", ["synchronize_rcu(", "kfree_rcu(", "call_rcu("], ["kfree("], [], 0,
     ["use-after-free", "rcu", "grace period", "uaf"],
     "Object freed without RCU grace period — RCU readers may still be accessing the object",
     "RCU delayed free (kfree_rcu/synchronize_rcu) added for safe deallocation"),
    ("C03", ["cond_resched(", "rcu_read_unlock("], [], [], 0,
     ["rcu stall", "rcu_sched", "stall", "rcu.*stall"],
     "RCU grace period stall — long-running RCU read critical section blocks grace period",
     "cond_resched or rcu_read_unlock added to shorten RCU read-side critical section"),
    ("M01", ["kfree("], [], ["goto ", "return -E"], 0,
     ["memory leak", "kmemleak", "leak", "missing free", "missing kfree"],
     "Memory leak — missing kfree on error/cleanup goto path",
     "kfree added on error goto cleanup path to fix memory leak"),
    ("M02", ["= NULL;", "= NULL)"], [], ["kfree(", "put_device(", "kmem_cache_free("], 1,
     ["double free", "double-free", "kasan", "null"],
     "Potential double free — pointer not nullified after deallocation",
     "pointer set to NULL after deallocation to prevent double free"),
    ("M03", ["kmalloc(", "kzalloc("], ["kmalloc(", "kzalloc("], ["sizeof("], 0,
     ["overflow", "size", "buffer", "allocation", "too small"],
     "Incorrect allocation size — buffer too small for target structure causing overflow",
     "allocation size corrected (kmalloc/kzalloc with proper sizeof)"),
    ("M04", ["kvmalloc(", "kvfree("], ["kmalloc(", "vmalloc("], [], 0,
     ["vmalloc", "kmalloc", "fallback", "large", "contiguous", "allocation fail"],
     "Large contiguous allocation may fail under memory pressure — kvmalloc with fallback needed",
     "kvmalloc/kvfree used with vmalloc fallback for large allocations"),
    ("M05", ["kmalloc(", "kzalloc("], [], [], 0,
     ["stack overflow", "stack frame", "stack size", "too large", "on stack"],
     "Excessive stack usage — large on-stack buffer or deep recursion exhausting kernel stack",
     "large stack allocation replaced with kmalloc/kzalloc on heap"),
    ("N01", ["if (!", "if (ptr", "IS_ERR_OR_NULL("], [],
     ["return -E", "return -ENOMEM", "return -EINVAL", "goto "], 0,
     ["null pointer", "null deref", "oops", "NULL", "null check"],
     "Null pointer dereference — missing NULL validation before pointer access",
     "NULL pointer check (if (!ptr)) added before dereference"),
    ("N02", ["return -E", "goto "], [], [], 0,
     ["error handling", "error path", "missing check", "return value"],
     "Missing error handling — function return value not checked for error",
     "error return value check and propagation added"),
    ("N03", ["if (", ">= ", "> ", "ARRAY_SIZE("], [], [], 0,
     ["out of bounds", "overflow", "index", "bounds", "OOB", "oob"],
     "Array/buffer index out of bounds — missing bounds validation before array access",
     "bounds check (index >= size or ARRAY_SIZE) added before access"),
    ("A01", ["atomic_inc(", "atomic_dec(", "atomic_cmpxchg(", "cmpxchg("], [], [], 0,
     ["race", "concurrent", "smp", "atomic", "data race"],
     "Non-atomic access in concurrent context — race condition on shared variable",
     "atomic operation (atomic_inc/atomic_dec/atomic_cmpxchg) used for concurrent access"),
    ("A02", ["smp_mb(", "smp_rmb(", "smp_wmb(", "barrier("], [], [], 0,
     ["race", "reorder", "memory ordering", "barrier", "smp"],
     "Memory ordering violation — missing memory barrier between ordered operations",
     "memory barrier (smp_mb/smp_rmb/smp_wmb) added for ordering guarantee"),
]

# Message fallback: (patterns, bug type, root cause); first group with a hit.
MESSAGE_FALLBACK = [
    (["deadlock", "lockdep", "circular locking"], "deadlock",
     "Potential lock ordering or circular dependency issue"),
    (["use.after.free", "use-after-free", "uaf", "kasan.*use.after.free"], "use_after_free",
     "Potential use-after-free detected by KASAN or code review"),
    (["double.free", "double-free"], "double_free",
     "Potential double free detected in memory deallocation"),
    (["null.*pointer", "null.*deref", "null ptr"], "null_pointer", "Potential null pointer dereference"),
    (["buffer.*overflow", "overflow.*buffer"], "buffer_overflow", "Potential buffer overflow"),
    (["out.of.bound", "out-of-bounds", "oob"], "out_of_bound", "Potential out-of-bounds access"),
    (["memory.*leak", "kmemleak", "memory leak"], "memory_leak", "Potential memory leak"),
    (["race.*condition", "race condition", "data race", "concurrent"], "race_condition",
     "Potential race condition"),
    (["softlockup", "hardlockup", "hung.task", "rcu.stall", "stall"], "hang",
     "Potential system hang or stall"),
    (["refcount", "kref.*put", "kref.*get", "ref.count"], "use_after_free",
     "Potential reference count imbalance"),
]
