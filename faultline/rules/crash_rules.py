"""Crash-log patterns and expert rules.

FIXED VALUES: regular expressions, keyword lists, labels and sentences that
must be reproduced verbatim for equal results.  Order breaks ties.
"""

TRACE_START = ["Call Trace:", "call trace:", "Call trace:", "Stack trace:", "Backtrace:",
               r"---\[ end trace [\da-fA-F]+ \]---"]
TRACE_END = [r"Code: (?:Bad RIP value\.|[0-9a-fA-F].+)", "Kernel panic - not syncing:",
             r"---\[ end trace", r"^\s*$"]
FRAME_FUNC = r"(?:\w+|0x[0-9a-fA-F]+)\+0x[0-9a-fA-F]+/0x[0-9a-fA-F]+"
FRAME_ADDR = r"\[\s*<[\da-fA-F]+>\]\s+"

# (name, case-insensitive pattern, number of groups)
PANIC_PATTERNS = [
    ("kernel_panic", r"Kernel panic - not syncing:\s*(.*)", 1),
    ("kernel_bug", r"(?:kernel\s+)?BUG\s*:\s*(.*)", 1),
    ("kernel_oops", r"Oops:\s*(.*)", 1),
    ("general_protection", r"general protection fault:\s*(.*)", 1),
    ("null_pointer_deref",
     r"unable to handle kernel (?:NULL pointer dereference|paging request)\s*(?:at\s*(\S+))?", 1),
    ("kasan_uaf", r"KASAN: use-after-free in\s*(\S+)", 1),
    ("kasan_double_free", r"KASAN: double-free or invalid free in\s*(\S+)", 1),
    ("kasan_oob", r"KASAN: (?:slab|global|stack)-out-of-bounds (?:Read|Write) in\s*(\S+)", 1),
    ("list_corruption", r"list_(?:del|add) corruption[.:]\s*(.*)", 1),
    ("hardlockup", r"(?:NMI watchdog:\s*)?Watchdog detected hard LOCKUP on cpu\s*(\d+)", 1),
    ("softlockup", r"BUG: soft lockup - CPU#(\d+) stuck for (\d+)s", 2),
    ("hungtask", r"INFO: task\s*(\S+)\s*blocked for more than (\d+) seconds", 2),
    ("rcu_stall", r"(?:INFO:\s*)?rcu_(\S+) (?:self-detected stall|detected stalls) on (?:CPU|cpus)", 1),
    ("refcount_underflow", r"refcount_t[:.]\s*(underflow|overflow|saturated)", 1),
    ("bug_on", r"kernel BUG at (\S+):(\d+)", 2),
    ("warning", r"WARNING:\s*(.*)", 1),
    ("machine_check", r"Machine Check Exception[.:]\s*(.*)", 1),
    ("divide_error", r"divide error:\s*(.*)", 1),
    ("ubsan", r"UBSAN:\s*(.*)", 1),
    ("bad_mode", r"Bad mode in\s*(\S+)\s*handler detected", 1),
    ("alignment_fault", r"Unhandled fault: alignment fault\s*\((\S+)\)", 1),
    ("irq_storm", r"irq\s*(\d+):\s*nobody cared", 1),
    ("stack_overflow", r"(?:do_IRQ:\s*)?stack (?:overflow|segment):", 0),
]

KERNEL_VERSION_PATTERNS = [r"Linux version (\d+\.\d+[\.\d]*[-\w+]*)",
                           r"Tainted:\s*.*?\s+(\d+\.\d+[\.\d]*[-\w]*)",
                           r"Kernel:\s*(\d+\.\d+[\.\d]*[-\w]*)"]
RIP_PATTERN = r"RIP:\s*(?:[0-9a-fA-F]+:)?(\w+)\+0x[0-9a-fA-F]+/0x[0-9a-fA-F]+"
MODULE_PATTERN = r"(\S+): loading out-of-tree module"

LOG_SUBSYSTEM_HINTS = [
    ("mm", ["mm/", "slab", "page_alloc", "folio", "vm_area", "swap", "kswapd", "oom",
            "out of memory", "memcg", "cma", "hugepage", "hugetlb"]),
    ("fs", ["fs/", "ext4", "xfs", "btrfs", "vfs", "inode", "dentry", "nfs", "cifs", "overlay",
            "fuse", "writeback"]),
    ("net", ["net/", "tcp", "udp", "socket", "skb", "dev_queue", "napi", "netif", "bridge",
             "iptables", "nf_", "conntrack"]),
    ("block", ["block/", "blk_", "bio_", "request_queue", "scsi", "nvme", "dm_"]),
    ("kernel", ["kernel/", "sched", "rcu", "irq", "timer", "workqueue", "futex", "signal", "syscall"]),
    ("drivers", ["drivers/", "pci", "usb", "i2c", "spi", "dma", "acpi", "gpio", "regulator", "clk_"]),
    ("arch", ["arch/", "x86", "arm64", "entry_", "syscall", "page_fault", "do_page_fault",
              "handle_mm_fault"]),
    ("bpf", ["bpf", "bpf_prog", "bpf_check"]),
    ("security", ["security/", "selinux", "apparmor", "lsm"]),
    ("cgroup", ["cgroup", "cgroupv2", "cgroupv1"]),
    ("kvm", ["kvm", "kvm_arch", "kvm_vcpu"]),
]
LOG_BUG_HINTS = [
    ("use_after_free", ["use-after-free", "use after free", "kasan: use-after-free"]),
    ("null_pointer", ["null pointer dereference", "null pointer", "unable to handle kernel null"]),
    ("buffer_overflow", ["buffer overflow", "stack overflow", "buffer overrun"]),
    ("memory_leak", ["out of memory", "oom", "memory leak", "invoked oom-killer"]),
    ("deadlock", ["deadlock", "circular locking dependency", "possible recursive locking",
                  "lockdep", "spinlock", "mutex_lock"]),
    ("race_condition", ["race condition", "race window", "race"]),
    ("double_free", ["double free", "double-free", "kasan: double-free"]),
    ("out_of_bound", ["out-of-bounds", "out of bounds", "kasan: slab-out-of-bounds",
                      "kasan: global-out-of-bounds"]),
    ("memory_corruption", ["list_del corruption", "list_add corruption", "memory corruption",
                           "list corruption"]),
    ("hang", ["hard lockup", "soft lockup", "hung task", "blocked for more", "rcu_sched stall",
              "nmi watchdog"]),
    ("crash", ["kernel panic", "general protection fault", "kernel bug", "machine check", "oops:",
               "divide error"]),
    ("concurrency", ["race", "lock contention", "synchronization"]),
    ("security", ["cve", "spectre", "meltdown", "retpoline"]),
]

# (id, name, bug type, severity, keywords, panic patterns, related subsystems, description)
EXPERT_RULES = [
    ("R001", "Spinlock Deadlock", "deadlock", 9,
     ["spin_lock", "queued_spin_lock_slowpath", "native_queued_spin_lock_slowpath",
      "_raw_spin_lock", "_raw_spin_lock_irqsave", "__raw_spin_lock_irqsave"], [],
     ["kernel", "core"],
     "自旋锁死锁 — 通常发生在中断上下文持有锁时再次申请同一把锁，或锁获取顺序不一致导致 ABBA 死锁。"),
    ("R004", "Mutex Deadlock", "deadlock", 9,
     ["mutex_lock", "mutex_lock_interruptible", "mutex_lock_killable", "__mutex_lock_slowpath",
      "mutex_lock_nested"],
     ["possible recursive locking", "circular locking dependency"], ["kernel", "core", "fs", "mm"],
     "互斥锁死锁 — 进程上下文中的锁循环依赖，lockdep 通常会提前检测到。"),
    ("R015", "RCU Stall / SRCU Stall", "hang", 8,
     ["rcu_sched", "rcu_bh", "rcu_preempt", "rcu_sched self-detected stall",
      "rcu_sched detected stalls", "SRCU", "srcu"],
     ["rcu_sched.*stall", "rcu_bh.*stall", "INFO: rcu_sched self-detected stall on CPU",
      "INFO: rcu_sched detected stalls on CPUs"], ["kernel", "rcu"],
     "RCU 宽限期停滞 — RCU 回调在宽限期内未能完成，通常是某个 CPU 在 RCU 读临界区中阻塞或死循环。"),
    ("R002", "Null Pointer Dereference", "null_pointer", 8,
     ["unable to handle kernel NULL pointer dereference", "unable to handle kernel paging request",
      "NULL pointer dereference"],
     ["unable to handle kernel NULL pointer dereference at", "PGD.*0000000000000000"],
     ["core", "drivers"],
     "空指针解引用 — 内核代码尝试访问地址 0 附近的内存，通常是因为指针未初始化或函数返回 NULL 未检查。"),
    ("R003", "Use After Free (KASAN)", "use_after_free", 9,
     ["KASAN: use-after-free", "slub_debug", "use-after-free", "kasan", "use after free"],
     ["KASAN: use-after-free in", "BUG .*use-after-free"], ["mm", "core", "net"],
     "释放后使用 — 内存已被释放但仍被访问。KASAN 检测到 slab/slub 对象在 free 后被使用。"
     "常见原因：引用计数错误、RCU 保护不足、竞态条件。"),
    ("R005", "Double Free (KASAN)", "double_free", 9,
     ["KASAN: double-free", "double free", "double-free", "slab double free"],
     ["KASAN: double-free", "kernel BUG at mm/slub.c", "Slab double-free detected"],
     ["mm", "net", "drivers"],
     "重复释放 — 同一内存区域被释放了两次，表明内存生命周期管理存在缺陷。"),
    ("R006", "Out-Of-Bounds Access (KASAN)", "out_of_bound", 9,
     ["KASAN: slab-out-of-bounds", "KASAN: global-out-of-bounds", "KASAN: stack-out-of-bounds",
      "out-of-bounds"],
     ["KASAN: slab-out-of-bounds (Read|Write) in", "KASAN: global-out-of-bounds",
      "KASAN: stack-out-of-bounds"], ["mm", "core", "net", "fs"],
     "越界访问 — 数组/缓冲区索引超出分配范围。KASAN 检测到对 slab/全局/栈对象的越界读写。"),
    ("R007", "Memory Corruption (List)", "memory_corruption", 8,
     ["list_del corruption", "list_add corruption", "list_add double add", "list corruption"],
     ["list_del corruption.*(LIST_POISON|prev->next|next->prev)",
      "list_add corruption.*prev->next should be", "list_add double add"],
     ["core", "mm", "net", "fs"],
     "链表损坏 — 内核链表操作检测到不一致状态。通常由竞态条件导致（多 CPU 同时修改同一链表而未加锁），"
     "或 UAF 导致链表节点被覆写。"),
    ("R008", "Page Fault / Bad Area", "memory_corruption", 8,
     ["unable to handle kernel paging request", "BUG: unable to handle page fault", "bad_area",
      "bad_area_nosemaphore"],
     ["unable to handle kernel paging request at", "BUG: unable to handle page fault"],
     ["mm", "arch"],
     "页错误 — 内核尝试访问无效的虚拟地址。原因包括：空指针、已释放的内存、物理内存损坏、页表损坏。"),
    ("R009", "Out of Memory (OOM)", "memory_leak", 7,
     ["Out of memory", "OOM", "oom-killer", "oom killer", "Killed process", "invoked oom-killer",
      "Memory cgroup out of memory"],
     ["Out of memory: Killed process", "oom-killer.*invoked", "Memory cgroup out of memory"], ["mm"],
     "内存耗尽 — 系统所有可用内存（包括 swap）已被耗尽，OOM Killer 被迫杀死进程。"
     "可能是内存泄漏或工作负载超出系统容量。"),
    ("R010", "Buffer Overflow (Non-KASAN)", "buffer_overflow", 8,
     ["buffer overflow", "stack buffer overflow", "heap buffer overflow", "buffer overrun"], [],
     ["core", "fs", "drivers"],
     "缓冲区溢出 — 写操作超出了分配缓冲区的大小，破坏相邻内存。"
     "可能是字符串操作缺少长度检查（strcpy/strcat/sprintf）。"),
    ("R011", "Refcount Underflow / Overflow", "use_after_free", 9,
     ["refcount_t", "refcount underflow", "refcount overflow", "refcount saturation",
      "refcount saturated"],
     ["refcount_t.*underflow", "refcount_t.*saturated", "refcount_t: underflow"],
     ["core", "mm", "net", "fs"],
     "引用计数下溢/溢出 — refcount_t 检测到引用计数操作异常。下溢意味着 put 多于 get（会导致 UAF），"
     "溢出意味着引用计数爆满。"),
    ("R012", "Hardlockup (NMI Watchdog)", "hang", 10,
     ["NMI watchdog", "hardlockup", "hard lockup", "Watchdog detected hard LOCKUP"],
     ["Watchdog detected hard LOCKUP on cpu", "NMI watchdog: BUG: soft lockup"],
     ["kernel", "core", "arch"],
     "硬锁死 — CPU 在内核态死循环且中断被长时间禁用。NMI 看门狗也无法触发调度。"
     "通常是自旋锁死锁或中断禁用时间过长。"),
    ("R013", "Softlockup", "hang", 8,
     ["softlockup", "soft lockup", "BUG: soft lockup", "soft lockup - CPU"],
     [r"BUG: soft lockup - CPU#\d+ stuck for \d+s"], ["kernel", "core", "drivers"],
     "软锁死 — CPU 在内核态长时间运行而未调用 schedule()。可能是循环条件错误、自旋锁持有时间过长、或中断风暴。"),
    ("R014", "Hungtask", "hang", 8,
     ["hungtask", "hung_task", "hung task", "INFO: task .* blocked for more than",
      "task .* blocked"],
     [r"INFO: task .* blocked for more than \d+ seconds", "blocked for more than"],
     ["fs", "block", "net", "nfs"],
     "任务挂起 — 进程在 D (UNINTERRUPTIBLE_SLEEP) 状态阻塞超过 120 秒。"
     "通常是 I/O 操作卡住、死锁、或 NFS 等服务不可达。"),
    ("R020", "Workqueue Stall", "hang", 7,
     ["workqueue", "work queue", "worker", "workqueue stall"], ["workqueue: .* stuck"],
     ["kernel", "core"],
     "工作队列停滞 — workqueue worker 线程卡住，无法处理队列中的工作项。"
     "可能是工作者函数死锁或长时间运行未返回。"),
    ("R016", "General Protection Fault (GPF)", "crash", 9,
     ["general protection fault", "general protection", "GPF", "iret exception"],
     ["general protection fault:",
      "general protection fault, probably for non-canonical address"], ["arch", "core", "mm"],
     "通用保护错误 — CPU 检测到权限违规（如用户态代码执行特权指令）、段限制违规、或非规范地址访问。"),
    ("R017", "Machine Check Exception (MCE)", "crash", 10,
     ["Machine Check Exception", "MCE", "machine check", "Hardware Error", "mcelog"],
     ["Machine Check Exception", "Hardware Error:", "mce:.*hardware error"], ["arch", "x86"],
     "机器检查异常 — CPU 检测到致命硬件错误（内存 ECC 错误、缓存错误、总线错误）。"
     "通常是硬件故障而非软件 Bug。"),
    ("R018", "Kernel BUG / BUG_ON", "crash", 9,
     ["kernel BUG at", "BUG: unable to handle kernel", "BUG_ON",
      "------------[ cut here ]------------"],
     ["kernel BUG at", "BUG: unable to handle kernel", r"------------\[ cut here \]------------"],
     ["core"],
     "内核 BUG — BUG_ON() 或 WARN_ON() 条件被触发，表明内核代码到达了不应执行到的路径（'impossible' condition）。"),
    ("R019", "Stack Overflow", "buffer_overflow", 9,
     ["stack overflow", "stack segment", "stack overrun", "recursion"],
     ["stack segment:", "stack overflow", "do_IRQ: stack overflow"], ["core", "arch", "fs"],
     "栈溢出 — 内核栈（通常 8KB-16KB）被耗尽。原因：过深的递归调用、栈上分配大缓冲区、中断嵌套。"),
    ("R021", "Division Error / Divide by Zero", "crash", 7,
     ["division error", "divide error", "divide by zero", "div0"],
     ["divide error:", "division by zero"], ["core", "drivers"],
     "除零错误 — CPU 执行除法指令且除数为 0。通常是因为模块参数未校验、或计算逻辑中存在边界情况。"),
    ("R022", "UBSAN Detected Undefined Behavior", "crash", 7,
     ["UBSAN", "ubsan", "undefined behavior", "UBSAN: shift-out-of-bounds",
      "UBSAN: array-index-out-of-bounds"],
     ["UBSAN: (shift-out-of-bounds|array-index-out-of-bounds|null-ptr-deref|signed-integer-overflow)"],
     ["core"],
     "UBSAN 检测到未定义行为 — 编译器未定义行为检测器发现移位越界、数组越界、空指针、有符号整数溢出等问题。"),
    ("R023", "Kernel Panic — Not Syncing", "crash", 10,
     ["Kernel panic - not syncing", "Kernel panic"], ["Kernel panic - not syncing:"], ["core"],
     "内核 Panic — 内核遇到不可恢复的错误主动停止。需要结合 panic 消息和 Call Trace 才能确定具体原因。"),
    ("R024", "Kernel Oops", "crash", 8, ["Oops:", "unable to handle kernel"], [r"Oops: \d+"], ["core"],
     "内核 Oops — 内核检测到非致命错误。Oops 后系统可能继续运行但处于不稳定状态，后续可能触发 Panic。"),
    ("R025", "Bad Mode / Undefined Instruction", "crash", 9,
     ["Bad mode", "undefined instruction", "illegal instruction", "Oops - undefined instruction"],
     ["Bad mode in .* handler detected", "Oops - undefined instruction:", "undefined instruction"],
     ["arch", "core"],
     "非法指令/异常模式 — CPU 尝试执行无效的指令或切换到非法的处理器模式。栈溢出导致返回地址损坏时常见。"),
    ("R026", "Data Abort / Alignment Fault", "crash", 8,
     ["data abort", "alignment fault", "unaligned memory access", "Unhandled fault: alignment fault"],
     ["Unhandled fault: alignment fault", "Unable to handle kernel .* at virtual address"],
     ["arch", "drivers"],
     "对齐错误 — 非对齐内存访问（主要在 ARM/ARM64 架构）。访问地址不是数据类型大小的倍数。"),
    ("R027", "Spectre / Meltdown Mitigation Check", "security", 6,
     ["spectre", "meltdown", "speculative execution", "retpoline", "SPEC_CTRL"], [], ["arch", "x86"],
     "侧信道缓解相关 — 与 Spectre/Meltdown 等 CPU 安全漏洞的缓解措施相关的问题或警告。"),
    ("R028", "IRQ / Interrupt Storm", "hang", 7,
     ["irq", "interrupt", "IRQ storm", "nobody cared", "irq.*nobody cared"],
     [r"irq \d+: nobody cared", r"Disabling IRQ #\d+"], ["kernel", "drivers"],
     "中断风暴/无人响应中断 — IRQ 线路上产生了大量中断但无驱动处理，或中断处理程序返回 IRQ_NONE。"
     "系统可能被中断风暴拖垮。"),
]

SEVERITY_TEXT = {
    10: "Critical — 系统无法恢复，必须立即定位修复",
    9: "Severe — 极可能导致数据损坏或安全漏洞",
    8: "High — 显著影响系统稳定性",
    7: "Medium-High — 需要及时修复",
    6: "Medium — 建议修复",
    5: "Low — 优化或改进",
}

LOCK_TRACE_FUNCTIONS = [
    "spin_lock", "spin_lock_irq", "spin_lock_irqsave", "spin_lock_bh", "spin_unlock",
    "spin_unlock_irq", "spin_unlock_irqrestore", "mutex_lock", "mutex_lock_interruptible",
    "mutex_lock_killable", "mutex_unlock", "mutex_trylock", "rwlock", "read_lock", "write_lock",
    "down_read", "down_write", "up_read", "up_write", "_raw_spin_lock", "_raw_spin_lock_irqsave",
    "queued_spin_lock_slowpath", "native_queued_spin_lock_slowpath", "__mutex_lock_slowpath",
    "mutex_lock_nested", "rt_mutex_lock", "rt_mutex_unlock", "lock_acquire", "lock_release",
    "lock_contended",
]
MEMORY_TRACE_FUNCTIONS = [
    "kmalloc", "kzalloc", "kfree", "vmalloc", "vfree", "kmem_cache_alloc", "kmem_cache_free",
    "kmem_cache_create", "__slab_alloc", "__slab_free", "slab_alloc", "slab_free", "alloc_pages",
    "__alloc_pages", "__alloc_pages_nodemask", "free_pages", "__free_pages", "page_frag_alloc",
    "kasan", "kasan_report", "kasan_check_read", "kasan_check_write", "page_fault", "do_page_fault",
    "handle_mm_fault", "handle_pte_fault", "__handle_mm_fault", "mmap", "munmap", "do_mmap",
    "do_munmap", "get_user_pages", "put_page", "__get_free_pages", "oom_kill_process",
    "out_of_memory", "page_alloc",
]
RCU_TRACE_FUNCTIONS = [
    "rcu_read_lock", "rcu_read_unlock", "synchronize_rcu", "synchronize_rcu_expedited", "call_rcu",
    "call_rcu_sched", "rcu_barrier", "rcu_barrier_sched", "rcu_assign_pointer", "rcu_dereference",
    "rcu_dereference_protected", "rcu_access_pointer", "rcu_report_dead", "rcu_cpu_stall_reset",
    "__rcu_read_lock", "__rcu_read_unlock", "srcu_read_lock", "srcu_read_unlock",
    "synchronize_srcu", "rcu_do_batch", "rcu_core", "rcu_process_callbacks", "rcu_sched_clock_irq",
    "rcu_check_callbacks", "kfree_rcu", "__kfree_rcu",
]
SCHED_TRACE_FUNCTIONS = [
    "schedule", "__schedule", "_cond_resched", "cond_resched", "schedule_timeout",
    "schedule_timeout_interruptible", "schedule_timeout_killable", "schedule_hrtimeout_range",
    "schedule_timeout_uninterruptible", "wait_for_completion", "wait_for_completion_interruptible",
    "wait_for_completion_timeout", "io_schedule", "io_schedule_timeout", "msleep",
    "msleep_interruptible", "ssleep", "do_nanosleep", "hrtimer_nanosleep", "__wait_event",
    "__wait_event_interruptible", "wake_up_process", "try_to_wake_up", "wake_up",
    "wake_up_interruptible", "do_exit", "do_group_exit", "__might_sleep", "__might_resched",
]
TRACE_SUBSYSTEM_HINTS = [
    ("mm", ["mm/", "slab", "page_", "alloc_pages", "folio", "mmap", "vma", "swap"]),
    ("fs", ["fs/", "ext4", "xfs", "btrfs", "vfs_", "file_", "inode", "dentry", "nfs"]),
    ("net", ["net/", "tcp_", "udp_", "sk_", "sock_", "dev_queue_xmit", "napi_", "netif_"]),
    ("block", ["block/", "blk_", "bio_", "request_queue", "scsi_", "nvme_"]),
    ("kernel", ["kernel/", "sched_", "rcu_", "irq_", "time_"]),
    ("drivers", ["drivers/", "pci_", "usb_", "i2c_", "spi_", "dma_"]),
    ("arch", ["arch/", "entry_", "syscall", "do_sys", "x86_", "arm64_"]),
]

# Layer 2: inferred issue -> (name, reason, score)
TRACE_ISSUES = {
    "deadlock_or_lock_contention": ("Lock Contention / Potential Deadlock",
                                    "调用栈中同时出现锁函数和调度函数，推断发生了锁竞争或死锁。", 0.65),
    "possible_lock_issue": ("Possible Lock-Related Issue", "调用栈中检测到锁相关函数，推断与锁操作有关。", 0.55),
    "rcu_related": ("RCU-Related Issue", "调用栈中检测到 RCU 相关函数，推断与 RCU 保护或宽限期有关。", 0.55),
    "memory_related": ("Memory Management Issue", "调用栈中检测到内存分配/释放相关函数，推断与内存管理有关。", 0.50),
    "scheduling_related": ("Scheduling-Related Issue", "调用栈中检测到调度相关函数，可能涉及 hungtask 或调度延迟。",
                           0.50),
}
# Layer 3: bug type -> (name, reason, score)
BUG_ABSTRACTIONS = {
    "deadlock": ("Kernel Deadlock", "检测到死锁特征，需要分析锁依赖关系。", 0.50),
    "race_condition": ("Kernel Race Condition", "检测到竞态条件特征，需要添加同步机制。", 0.50),
    "use_after_free": ("Use-After-Free", "检测到释放后使用特征，需要修复内存生命周期管理。", 0.50),
    "null_pointer": ("Null Pointer Dereference", "检测到空指针特征，需要添加空指针检查。", 0.50),
    "double_free": ("Double Free", "检测到重复释放特征，需要修复释放逻辑。", 0.50),
    "buffer_overflow": ("Buffer Overflow", "检测到缓冲区溢出特征，需要添加边界检查。", 0.50),
    "out_of_bound": ("Out-of-Bounds Access", "检测到越界访问特征，需要添加索引检查。", 0.50),
    "memory_leak": ("Memory Leak", "检测到内存泄漏特征，需要修复资源释放逻辑。", 0.45),
    "memory_corruption": ("Memory Corruption", "检测到内存损坏特征，可能由竞态或缓冲区问题引起。", 0.50),
    "hang": ("System Hang", "检测到系统挂起特征，需要分析阻塞点。", 0.50),
    "crash": ("Kernel Crash", "检测到内核崩溃特征，需要结合 Call Trace 定位原因。", 0.45),
    "security": ("Security Vulnerability", "检测到安全漏洞特征，需优先修复。", 0.55),
    "regression": ("Kernel Regression", "检测到回归问题，需要 bisect 定位引入的 commit。", 0.40),
    "concurrency": ("Concurrency Issue", "检测到并发问题，需要分析同步机制。", 0.50),
}
# Layer 4: (pattern, name, reason, score)
PANIC_HINTS = [
    ("spin.?lock", "Possible Spinlock Issue", "Panic 消息包含自旋锁相关关键词", 0.45),
    ("mutex", "Possible Mutex Issue", "Panic 消息包含互斥锁相关关键词", 0.45),
    ("deadlock", "Possible Deadlock", "Panic 消息包含死锁关键词", 0.50),
    ("race", "Possible Race Condition", "Panic 消息包含竞态关键词", 0.45),
    ("uaf|use.?after.?free", "Possible Use-After-Free", "Panic 消息包含 UAF 关键词", 0.50),
    ("double.?free", "Possible Double Free", "Panic 消息包含 double-free 关键词", 0.50),
    ("null.*pointer", "Possible Null Pointer", "Panic 消息包含空指针关键词", 0.50),
    ("oob|out.?of.?bound", "Possible Out-of-Bounds", "Panic 消息包含越界关键词", 0.45),
    ("overflow", "Possible Overflow", "Panic 消息包含溢出关键词", 0.40),
    ("corruption|corrupt", "Possible Memory Corruption", "Panic 消息包含损坏关键词", 0.45),
    ("timeout|timed.?out", "Possible Timeout", "Panic 消息包含超时关键词", 0.40),
    ("stall|stuck|hung", "Possible Task Stall", "Panic 消息包含停滞关键词", 0.45),
    ("oom|out.?of.?memory", "Possible OOM", "Panic 消息包含 OOM 关键词", 0.50),
]
UNKNOWN_CAUSE = ("Unknown Root Cause", "无法从可用特征中确定根因。建议人工检查 vmcore 和完整 dmesg。", 0.10)

# FIXED VALUES: bug type -> (flags, search keywords)
FIX_HINTS = {
    "deadlock": (["needs_lock_fix"], ["spin_lock", "mutex_lock", "lock order", "lockdep"]),
    "race_condition": (["needs_lock_fix", "needs_rcu_fix"], ["spin_lock", "mutex_lock", "atomic", "synchronization", "rcu"]),
    "use_after_free": (["needs_refcount_fix", "needs_rcu_fix"], ["kref", "refcount", "kfree_rcu", "synchronize_rcu"]),
    "double_free": (["needs_refcount_fix"], ["kref_put", "refcount_dec", "NULL after free"]),
    "null_pointer": (["needs_null_check"], ["NULL check", "null check", "error handling"]),
    "buffer_overflow": (["needs_bound_check"], ["strscpy", "snprintf", "bounds check", "size check"]),
    "out_of_bound": (["needs_bound_check"], ["bounds check", "index check", "array size"]),
    "memory_leak": (["needs_refcount_fix"], ["kfree", "memory leak", "free", "put"]),
    "memory_corruption": (["needs_lock_fix", "needs_refcount_fix"], ["spin_lock", "mutex_lock", "refcount", "synchronization"]),
    "hang": (["needs_lock_fix"], ["cond_resched", "schedule_timeout", "timeout", "spin_unlock"]),
    "concurrency": (["needs_lock_fix"], ["spin_lock", "mutex_lock", "atomic", "cmpxchg"]),
    "security": (["needs_lock_fix", "needs_refcount_fix", "needs_bound_check"], ["CVE", "security", "privilege", "bounds"]),
}
FIX_SENTENCES = [
    ("needs_lock_fix", "adds spin_lock or mutex_lock synchronization"),
    ("needs_refcount_fix", "adds refcount_inc/kref_get or fixes kref_put pairing"),
    ("needs_rcu_fix", "adds kfree_rcu or synchronize_rcu protection"),
    ("needs_null_check", "adds NULL pointer check or error handling"),
    ("needs_bound_check", "adds boundary check or buffer size validation"),
]

# Evidence: (label, case-insensitive patterns), first match.
PANIC_LABELS = [
    ("NULL pointer dereference", ["NULL pointer dereference", "unable to handle kernel NULL pointer"]),
    ("Use-After-Free (KASAN)", ["KASAN: use-after-free"]),
    ("Double Free (KASAN)", ["KASAN: double-free"]),
    ("List Corruption", ["list_del corruption", "list_add corruption"]),
    ("Out-of-Bounds Access (KASAN)", ["KASAN: slab-out-of-bounds", "KASAN: global-out-of-bounds"]),
    ("Stack Overflow", ["stack overflow", "stack segment:"]),
    ("Page Fault", ["unable to handle kernel paging request", "BUG: unable to handle page fault"]),
    ("Soft Lockup", ["soft lockup", "BUG: soft lockup"]),
    ("Hard Lockup", ["hard lockup", "BUG: hard lockup"]),
    ("RCU Stall", ["rcu_sched.*stall", "rcu_bh.*stall", "INFO: rcu_sched self-detected stall"]),
    ("Kernel Oops", ["Oops:", "unable to handle kernel"]),
    ("Kernel Panic", ["Kernel panic - not syncing", "Kernel panic"]),
    ("OOM (Out of Memory)", ["Out of memory", "oom-killer", "invoked oom-killer"]),
    ("Deadlock (lockdep)", ["possible recursive locking", "circular locking dependency",
                            "possible deadlock"]),
    ("Division Error", ["divide error", "division by zero"]),
    ("UBSAN Undefined Behavior", ["UBSAN:"]),
    ("Bad Mode / Undefined Instruction", ["Bad mode", "undefined instruction"]),
    ("Data Abort / Alignment Fault", ["alignment fault", "data abort"]),
]
FAULT_ADDRESS_PATTERN = r"(?:at virtual address|address:)\s*([0-9a-fA-Fx]+)"
ERROR_CODE_PATTERN = r"(?:error_code\s*\(\s*0x[0-9a-fA-F]+\s*\)|#PF:[^\n]*)"

POSSIBLE_CAUSES = {
    "null_pointer": ["Missing NULL check — 函数返回 NULL 后未检查即解引用",
                     "Object lifecycle problem — 对象已被释放但仍被引用",
                     "Released object access — 访问了已 kfree/kobject_put 的对象",
                     "Driver initialization failure — 驱动 probe 失败但指针未置 NULL"],
    "use_after_free": ["Missing reference count increment — 访问前未增加引用计数",
                       "RCU grace period violation — rcu_read_unlock 后继续使用 RCU 保护的对象",
                       "Race condition in free path — 并发路径同时释放同一对象",
                       "Workqueue / timer callback after free — 异步回调在对象释放后仍触发"],
    "race_condition": ["Missing lock protection — 并发访问共享数据未加锁",
                       "Lock ordering violation — ABBA 死锁导致数据不一致",
                       "Atomic operation needed — 应使用 atomic/cmpxchg 而非普通赋值",
                       "RCU synchronization missing — 更新 RCU 保护的数据后未调用 synchronize_rcu"],
    "deadlock": ["ABBA lock ordering — 两个路径以相反顺序获取同一对锁",
                 "Interrupt context lock re-acquisition — 中断中申请已持有的锁",
                 "Blocking in RCU read-side critical section — RCU 读临界区中执行阻塞操作",
                 "Nested same lock type — 同一路径中重复获取同一把锁"],
    "memory_corruption": ["Buffer overflow — 写操作超出分配边界",
                          "Use-after-free — 使用已释放的内存覆盖了活跃对象",
                          "Concurrent list modification — 无锁保护的链表并发修改",
                          "DMA / hardware memory corruption — 硬件或 DMA 导致的物理内存错误"],
    "double_free": ["Missing NULL-after-free — 释放后未将指针置 NULL, 导致二次释放",
                    "Reference counting error — kref_put 被调用了多余次数",
                    "Error path double free — 正常路径和错误路径都释放了同一对象"],
    "hang": ["Infinite loop without schedule point — 循环中缺少 cond_resched() 调度点",
             "Deadlock — 进程在 D 状态阻塞等待永远不会释放的锁",
             "NFS / storage unresponsive — 远程文件系统或存储设备无响应",
             "Interrupt storm — 大量中断导致 CPU 无法执行用户态任务"],
    "memory_leak": ["Missing kfree in error path — 错误返回路径遗漏了内存释放",
                    "Reference count leak — kref_get 后缺少对应的 kref_put",
                    "Cache / pool growth without reclaim — slab 缓存无限制增长",
                    "Page allocation without corresponding free — alloc_pages 缺少 free_pages"],
    "buffer_overflow": ["Unbounded string copy — 使用 strcpy/sprintf 而非 strscpy/snprintf",
                        "Missing array bounds check — 数组索引未校验合法性",
                        "Off-by-one error — 循环边界条件错误导致多写一个元素"],
    "out_of_bound": ["Array index out of range — 索引值超出数组分配大小",
                     "Network packet parsing overflow — 解析畸形网络包时越界",
                     "Metadata-too-large assumption — 假设元数据大小不超过某个值但实际超了"],
    "crash": ["Stack overflow — 过深递归或栈上大缓冲区导致栈耗尽",
              "Hardware error — 物理内存/CPU 缓存硬件故障",
              "Corrupted kernel text — 内核代码段被意外覆写"],
    "security": ["Information leak to userspace — 内核栈/堆数据泄漏到用户态",
                 "Privilege escalation — 用户态代码获得了内核态权限",
                 "Unvalidated userspace pointer — 直接解引用用户态传入的指针"],
}
POSSIBLE_CAUSES_DEFAULT = ["Insufficient evidence — 当前日志信息不足以确定深层原因",
                           "建议人工审查 vmcore 和完整 dmesg 以获取更多证据"]
SUBSYSTEM_CONTEXTS = {
    "net": "[net] 网络子系统常见触发场景: 设备初始化竞态、数据包处理路径中的未初始化指针、ioctl/sysfs 竞态",
    "mm": "[mm] 内存子系统常见触发场景: 内存分配/释放配对错误、页表操作竞态、slab 缓存管理缺陷",
    "fs": "[fs] 文件系统常见触发场景: inode/dentry 生命周期管理、并发文件操作、VFS 层回调中的未检查指针",
    "kernel": "[kernel] 内核核心常见触发场景: 调度路径中的未初始化对象、RCU 保护不足、锁排序错误",
    "drivers": "[drivers] 驱动常见触发场景: probe/release 函数中的资源管理、中断处理中的竞态、DMA 映射错误",
}
CAUSE_TRACE_FORMAT = "崩溃调用栈经过 {funcs}，该路径可能存在指针有效性检查缺失或并发访问保护不足"

# Evidence coverage: item -> weight
COVERAGE_ITEMS = [("Panic Keyword", 3), ("Fault Address", 2), ("Call Trace", 3), ("Kernel Version", 3),
                  ("Error Code", 1), ("Subsystem", 2), ("Loaded Modules", 1), ("Commit Diff", 3),
                  ("Expert Rule", 3)]

# Model-answer validation sets.
VALID_SUBSYSTEMS = ["mm", "fs", "net", "block", "kernel", "drivers", "arch", "security", "bpf",
                    "cgroup", "rcu", "kvm", "crypto", "power", "unknown"]
VALID_BUG_TYPES = ["use_after_free", "null_pointer", "buffer_overflow", "memory_leak", "deadlock",
                   "race_condition", "integer_overflow", "out_of_bound", "double_free",
                   "memory_corruption", "hang", "crash", "security", "concurrency", "regression",
                   "resource_leak", "logic_error", "unknown"]
VALID_SEVERITIES = ["critical", "high", "medium", "low"]
VALID_FIX_HINTS = ["lock_added", "refcount_fix", "rcu_fix", "null_check", "bound_check",
                   "error_handling"]

# Memory-dump inference lists.
DUMP_LOCK_FUNCTIONS = ["spin_lock", "mutex_lock", "down_read", "down_write",
                       "queued_spin_lock_slowpath", "__mutex_lock_slowpath"]
DUMP_MEMORY_FUNCTIONS = ["kmalloc", "kfree", "kmem_cache_alloc", "kmem_cache_free", "slab_alloc",
                         "slab_free", "kasan_report"]
DUMP_SUBSYSTEM_HINTS = [
    ("mm", ["mm_", "slab_", "page_", "folio_", "vm_", "handle_mm_fault", "do_page_fault"]),
    ("fs", ["vfs_", "ext4_", "xfs_", "btrfs_", "file_", "inode_", "dentry_"]),
    ("net", ["tcp_", "udp_", "sk_", "sock_", "dev_queue_xmit", "napi_", "netif_"]),
    ("block", ["blk_", "bio_", "scsi_", "nvme_"]),
    ("kernel", ["sched_", "rcu_", "irq_", "timer_", "workqueue_"]),
    ("drivers", ["pci_", "usb_", "i2c_", "spi_", "dma_"]),
]

# Report panic classes: (any-of substrings, label), first match on lower text.
PANIC_CLASSES = [
    (["kernel oops", "oops:"], "Kernel Oops"), (["kernel bug", "bug:"], "Kernel BUG"),
    (["kasan"], "KASAN Report"), (["lockdep"], "Lockdep Report"), (["rcu stall"], "RCU Stall"),
    (["hung task", "hung_task"], "Hung Task"), (["hard lockup", "hardlockup"], "Hard Lockup"),
    (["soft lockup", "softlockup"], "Soft Lockup"), (["mce"], "Machine Check Exception"),
    (["gpf"], "General Protection Fault"),
]
PANIC_CLASS_PANIC = ("kernel panic", [(["out of memory", "oom"], "Kernel Panic (OOM)"),
                                      (["vfs", "filesystem"], "Kernel Panic (VFS)")], "Kernel Panic")
SEVERITY_LABELS = [(0.85, "CRITICAL"), (0.70, "HIGH"), (0.50, "MEDIUM"), (0.30, "LOW")]
