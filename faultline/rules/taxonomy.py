"""Bug-type taxonomy and commit-side vocabularies.

FIXED VALUES: every literal below is part of the published contract (labels,
keyword lists, patterns, constants).  Order is significant wherever a
first-match rule reads the table.
"""

# Canonical bug types, in containment-scan order.
BUG_TYPES = [
    "null_pointer", "use_after_free", "double_free", "buffer_overflow", "out_of_bound",
    "memory_corruption", "memory_leak", "use_before_init", "uninitialized",
    "deadlock", "race_condition", "hang", "rcu_stall", "soft_lockup", "oom",
    "resource_leak", "security", "crash", "regression", "performance", "logic_error",
    "configuration", "integer_overflow", "stack_overflow", "unknown",
]

BUG_TYPE_ALIASES = {
    "uaf": "use_after_free", "oob": "out_of_bound", "npd": "null_pointer",
    "null_pointer_dereference": "null_pointer", "null_pointer_deref": "null_pointer",
    "null_ptr": "null_pointer", "use-after-free": "use_after_free",
    "use after free": "use_after_free", "double-free": "double_free",
    "double free": "double_free", "use_before_initialization": "use_before_init",
    "buffer_overflow": "buffer_overflow", "buffer overrun": "buffer_overflow",
    "out-of-bounds": "out_of_bound", "out of bounds": "out_of_bound",
    "memory_leak": "memory_leak", "memory-corruption": "memory_corruption",
    "memory corruption": "memory_corruption", "list_corruption": "memory_corruption",
    "race": "race_condition", "race-condition": "race_condition",
    "data race": "race_condition", "data_race": "race_condition",
    "concurrency": "race_condition", "rcu-stall": "rcu_stall", "rcu stall": "rcu_stall",
    "rcu_sched_stall": "rcu_stall", "soft-lockup": "soft_lockup", "softlockup": "soft_lockup",
    "hardlockup": "hang", "hard_lockup": "hang", "hungtask": "hang", "hung_task": "hang",
    "out-of-memory": "oom", "out of memory": "oom", "resource-leak": "resource_leak",
    "resource leak": "resource_leak", "stack-overflow": "stack_overflow",
    "stack overflow": "stack_overflow", "integer-overflow": "integer_overflow",
    "integer overflow": "integer_overflow", "kernel_panic": "crash", "kernel oops": "crash",
    "general protection": "crash", "general protection fault": "crash", "gpf": "crash",
    "machine check": "crash", "mce": "crash", "security vulnerability": "security",
    "cve": "security", "regression": "regression", "performance regression": "performance",
    "logic error": "logic_error", "configuration error": "configuration",
}

BUG_CATEGORIES = {
    "memory": ["null_pointer", "use_after_free", "double_free", "buffer_overflow", "out_of_bound",
               "memory_corruption", "memory_leak", "use_before_init", "uninitialized",
               "stack_overflow", "integer_overflow"],
    "concurrency": ["deadlock", "race_condition"],
    "hang": ["hang", "rcu_stall", "soft_lockup"],
    "resource": ["oom", "resource_leak"],
    "security": ["security"],
}

BUG_DESCRIPTIONS = {
    "use_after_free": "使用已释放的内存", "null_pointer": "空指针解引用", "buffer_overflow": "缓冲区溢出",
    "memory_leak": "内存泄漏", "deadlock": "死锁", "race_condition": "竞态条件",
    "integer_overflow": "整数溢出", "out_of_bound": "越界访问", "double_free": "重复释放",
    "use_before_init": "初始化前使用", "uninitialized": "未初始化变量", "memory_corruption": "内存损坏",
    "concurrency": "并发问题", "hang": "系统挂起", "crash": "崩溃", "regression": "回归问题",
    "security": "安全漏洞", "performance": "性能问题", "resource_leak": "资源泄漏",
    "logic_error": "逻辑错误", "configuration": "配置问题", "unknown": "未知类型",
}
BUG_DESCRIPTION_DEFAULT = "未知类型"

# First group with any substring hit in lower(subject + ' ' + body) wins.
BUG_TYPE_KEYWORDS = [
    ("use_after_free", ["use after free", "use-after-free", "use_after_free", "freed pointer",
                        "dangling pointer", "use after freed"]),
    ("null_pointer", ["null pointer", "null ptr", "dereference null", "null dereference",
                      "null ptr deref", "npe"]),
    ("buffer_overflow", ["buffer overflow", "buffer overrun", "stack overflow", "heap overflow",
                         "out of bounds write", "overwrite"]),
    ("memory_leak", ["memory leak", "leak", "unfreed", "not freed", "missing free", "resource leak"]),
    ("deadlock", ["deadlock", "lock order", "circular wait", "mutex deadlock", "spinlock deadlock"]),
    ("race_condition", ["race condition", "data race", "concurrent access", "race", "thread safety",
                        "atomicity"]),
    ("integer_overflow", ["integer overflow", "int overflow", "overflow", "signed overflow",
                          "unsigned overflow"]),
    ("out_of_bound", ["out of bound", "out-of-bounds", "index out of range", "array index",
                      "buffer overread", "read beyond"]),
    ("double_free", ["double free", "double-free", "free twice", "double dealloc", "multiple free"]),
    ("use_before_init", ["use before init", "use-before-init", "uninitialized", "undefined value",
                         "garbage value"]),
    ("uninitialized", ["uninitialized", "not initialized", "init missed", "zero init",
                       "missing initialization"]),
    ("memory_corruption", ["memory corruption", "corrupt memory", "memory damage", "corrupted data",
                           "memory overwrite"]),
    ("concurrency", ["concurrency", "thread", "parallel", "mutex", "spinlock", "atomic",
                     "synchronization"]),
    ("hang", ["hang", "hung", "stall", "freeze", "unresponsive"]),
    ("crash", ["crash", "panic", "oops", "segfault", "segmentation fault", "abort"]),
    ("regression", ["regression", "broke", "introduced", "revert"]),
    ("security", ["security", "cve", "exploit", "vulnerability", "privilege", "escalation", "attack"]),
    ("performance", ["performance", "slow", "latency", "throughput", "optimization", "speed up",
                     "bottleneck"]),
    ("resource_leak", ["resource leak", "fd leak", "file descriptor leak", "socket leak", "handle leak"]),
    ("logic_error", ["logic error", "wrong logic", "incorrect", "bug", "mistake", "error"]),
    ("configuration", ["config", "configuration", "setting", "option"]),
]

# (subsystem, path prefixes): subsystem-major first match.
SUBSYSTEM_PATHS = [
    ("mm", ["mm/", "mmap/", "slab/", "vmalloc/", "page_alloc/"]),
    ("fs", ["fs/", "ext2/", "ext3/", "ext4/", "btrfs/", "xfs/", "vfs/"]),
    ("net", ["net/", "socket/", "tcp/", "udp/", "ipv4/", "ipv6/"]),
    ("block", ["block/", "bio/"]),
    ("driver", ["drivers/", "driver/"]),
    ("usb", ["drivers/usb/", "usb/"]),
    ("pci", ["drivers/pci/", "pci/"]),
    ("scsi", ["drivers/scsi/", "scsi/"]),
    ("nvme", ["drivers/nvme/", "nvme/"]),
    ("crypto", ["crypto/", "drivers/crypto/"]),
    ("security", ["security/", "selinux/", "apparmor/"]),
    ("kernel", ["kernel/", "sched/", "locking/", "time/"]),
    ("irq", ["kernel/irq/", "irq/"]),
    ("rcu", ["kernel/rcu/", "rcu/"]),
    ("kvm", ["virt/kvm/", "kvm/"]),
    ("virt", ["virt/", "hypervisor/"]),
    ("power", ["power/", "pm/"]),
    ("acpi", ["acpi/", "drivers/acpi/"]),
    ("dt", ["devicetree/", "dt-bindings/"]),
    ("firmware", ["firmware/", "drivers/firmware/"]),
    ("lib", ["lib/", "lib/string/", "lib/list/"]),
    ("tools", ["tools/", "scripts/"]),
    ("doc", ["Documentation/", "doc/"]),
    ("arch", ["arch/", "arch/x86/", "arch/arm/", "arch/arm64/"]),
    ("bpf", ["bpf/", "kernel/bpf/", "tools/bpf/"]),
    ("cgroup", ["kernel/cgroup/", "cgroup/"]),
    ("nfs", ["fs/nfs/", "nfs/"]),
    ("smb", ["fs/cifs/", "smb/"]),
]

COLLECTOR_PARENTS = {
    "usb": "driver", "pci": "driver", "scsi": "driver", "nvme": "driver", "irq": "kernel",
    "rcu": "kernel", "bpf": "kernel", "cgroup": "kernel", "acpi": "power", "kvm": "virt",
    "crypto": "security",
}

SUBSYSTEM_CONTENT_KEYWORDS = [
    ("mm", ["page", "memory", "alloc", "free", "slab", "vmalloc", "kmem"]),
    ("fs", ["file", "inode", "super", "mount", "vfs", "dentry"]),
    ("net", ["socket", "tcp", "udp", "ip", "sk_buff", "network"]),
    ("block", ["bio", "block", "request", "queue"]),
    ("crypto", ["crypt", "hash", "cipher", "sha", "md5"]),
    ("rcu", ["rcu", "synchronize_rcu", "rcu_read_lock"]),
    ("irq", ["irq", "interrupt", "handler"]),
    ("power", ["power", "pm", "sleep", "wakeup"]),
    ("bpf", ["bpf", "ebpf"]),
]

# Added-line keyword lists and message patterns.
LOCK_KEYWORDS = [
    "spin_lock", "spin_unlock", "spin_lock_irqsave", "spin_lock_irq", "mutex_lock", "mutex_unlock",
    "mutex_init", "rwlock", "rwsem", "semaphore", "mutex_lock_interruptible", "mutex_lock_killable",
    "down_read", "down_write", "up_read", "up_write", "lockdep", "lock_acquire", "lock_release",
]
REFCOUNT_KEYWORDS = [
    "refcount_inc", "refcount_dec", "refcount_add", "refcount_set", "refcount_read",
    "refcount_inc_not_zero", "kref_get", "kref_put", "kref_init", "atomic_inc", "atomic_dec",
    "atomic_add", "atomic_set", "get_", "put_",
]
REFCOUNT_PATTERNS = [
    "refcount.*leak", "ref.*leak", "missing.*(?:get|put)", "extra.*(?:get|put)",
    "wrong.*refcount", "inconsistent.*ref",
]
RCU_KEYWORDS = [
    "rcu_read_lock", "rcu_read_unlock", "synchronize_rcu", "synchronize_rcu_expedited", "call_rcu",
    "call_rcu_sched", "call_rcu_bh", "rcu_barrier", "rcu_assign_pointer", "rcu_dereference",
    "rcu_access_pointer", "rcu_swap_pointer", "rcu_replace_pointer", "rcu_head", "rcu_callback",
    "synchronize_srcu", "srcu_read_lock", "srcu_read_unlock",
]
RCU_PATTERNS = ["rcu.*(?:bug|fix|issue|race|deadlock)", "synchronize.*rcu"]

# Case-insensitive whole-word patterns, label emitted once.
FIX_TAG_WORDS = [
    ("Fixes", "Fixes"), ("fix", "fix"), ("BUG", "BUG"), ("bug", "bug"), ("CVE", "CVE"),
    ("security", "security"), ("crash", "crash"), ("panic", "panic"), ("oops", "oops"),
    ("deadlock", "deadlock"), ("patch", "patch"), ("revert", "revert"),
    ("regression", "regression"), ("leak", "leak"), ("corruption", "corruption"), ("race", "race"),
    ("overflow", "overflow"), ("null", "null"), ("stable", "stable"), ("backport", "backport"),
    ("upstream", "upstream"),
]
FIX_COMMIT_WORDS = ["fix", "fixes", "fixed", "bug", "cve", "patch", "revert", "backport"]
REFERENCE_PREFIXES = ["Fixes", "Closes", "Resolves"]
PERSON_TAGS = ["Reported-by", "Suggested-by", "Tested-by", "Reviewed-by", "Acked-by"]
CVE_PATTERN = r"CVE-\d{4}-\d{4,}"
EMAIL_PATTERN = r"[\w.+-]+@[\w-]+\.[\w.-]+"

# Importance score: base by bug type, then additive parts, capped at 10.
BUG_BASE_SCORES = {
    "security": 10.0, "use_after_free": 9.0, "null_pointer": 8.0, "buffer_overflow": 9.0,
    "deadlock": 8.0, "race_condition": 8.0, "memory_leak": 7.0, "crash": 7.0, "regression": 6.0,
    "performance": 5.0,
}

# Keywords that make a '+' line a key diff line.
KEY_LINE_WORDS = [
    "spin_lock", "spin_unlock", "mutex_lock", "mutex_unlock", "kref_get", "kref_put", "kref_init",
    "refcount_inc", "refcount_dec", "refcount_add", "kfree", "kmalloc", "kzalloc", "kfree_rcu",
    "synchronize_rcu", "rcu_read_lock", "rcu_read_unlock", "if (!", "NULL", "null", "return -",
    "goto ", "error", "BUG", "WARN", "atomic_inc", "atomic_dec", "atomic_read", "atomic_cmpxchg",
    "down_read", "down_write", "up_read", "up_write", "smp_mb", "smp_rmb", "smp_wmb",
    "cond_resched", "schedule_timeout", "put_device", "get_device", "IS_ERR_OR_NULL", "snprintf",
    "strscpy", "scnprintf",
]
KEY_LINE_WORDS_SIMPLE = [
    "spin_lock", "spin_unlock", "mutex_lock", "mutex_unlock", "kref_get", "kref_put", "kref_init",
    "refcount_inc", "refcount_dec", "kfree", "kmalloc", "kzalloc", "kfree_rcu", "synchronize_rcu",
    "rcu_read_lock", "rcu_read_unlock", "if (!", "NULL", "null", "return -", "goto", "error", "BUG",
    "WARN", "atomic_inc", "atomic_dec", "atomic_read",
]

# (major, minor, release date), newest first.
KERNEL_RELEASES = [
    (6, 12, "2024-12-01"), (6, 11, "2024-09-15"), (6, 10, "2024-07-14"), (6, 9, "2024-05-12"),
    (6, 8, "2024-03-10"), (6, 7, "2024-01-07"), (6, 6, "2023-10-29"), (6, 5, "2023-08-27"),
    (6, 4, "2023-06-25"), (6, 3, "2023-04-23"), (6, 2, "2023-02-19"), (6, 1, "2022-12-11"),
    (6, 0, "2022-10-02"), (5, 19, "2022-07-31"), (5, 18, "2022-05-22"), (5, 17, "2022-03-20"),
    (5, 16, "2022-01-09"), (5, 15, "2021-10-31"), (5, 14, "2021-08-29"), (5, 13, "2021-06-27"),
    (5, 12, "2021-04-25"), (5, 11, "2021-02-14"), (5, 10, "2020-12-13"), (5, 9, "2020-10-11"),
    (5, 8, "2020-08-02"), (5, 7, "2020-05-31"), (5, 6, "2020-03-29"), (5, 5, "2020-01-26"),
    (5, 4, "2019-11-24"), (5, 3, "2019-09-15"), (5, 2, "2019-07-07"), (5, 1, "2019-05-05"),
    (5, 0, "2019-03-03"), (4, 20, "2018-12-23"), (4, 19, "2018-10-22"), (4, 18, "2018-08-12"),
    (4, 17, "2018-06-03"), (4, 16, "2018-04-01"), (4, 15, "2018-01-28"), (4, 14, "2017-11-12"),
    (4, 13, "2017-09-03"), (4, 12, "2017-07-02"), (4, 11, "2017-04-30"), (4, 10, "2017-02-19"),
    (4, 9, "2016-12-11"),
]
