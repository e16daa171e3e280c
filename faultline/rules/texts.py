"""FIXED VALUES: sentences of reasons, comparisons and reports, as they must read."""

GRADE_HIGH = "高度匹配"
GRADE_MARKED = "显著相关"
GRADE_MIDDLE = "中度相关"
GRADE_LOW = "低度相关"
SUBSYSTEM_IS = "子系统="
BUG_TYPE_IS = "Bug类型="
MEANING_CLOSE = "语义高度相似"
SUBSYSTEM_EXACT = "子系统精确匹配"
SUBSYSTEM_PARTLY = "子系统部分匹配"
STACK_HIT = "调用栈直接命中"
STACK_NEAR = "调用栈间接关联"
VERSION_FITS = "版本兼容"
VERSION_POOR = "版本兼容性偏低"
RULE_FITS = "专家规则高度匹配"
VERSION_MISSING = "Unknown — Crash Kernel Version 未提供"
GAP = " (差 "
SAME_BUG = "同属于 "
FIX_END = " 修复"
SAME_SUBSYSTEM = "同一子系统 "
SAME_VECTOR = "Embedding 相似度相同，差异来自后续排序阶段"
SAME_VERSION = "版本兼容性相当 (权重 "
OTHER_BUG = "Bug 类型不同 ("
OTHER_BUG_END = ")，Top-1 更匹配当前根因"
OTHER_SUBSYSTEM = "属于 "
OTHER_SUBSYSTEM_END = " 子系统，与崩溃子系统关联度低于 "
FINAL_SCORES = "综合评分: Top1="
VECTOR_SCORES = "Embedding 相似度: Top1="
RERANK_SCORES = "Cross Encoder 重排: Top1="
LOWER_VERSION = "版本兼容性较低 (权重 "
VERSION_WEIGHT = "版本匹配权重 "
OFF_NEUTRAL = " (偏离中性值 1.0)"
RANK_OF = "综合 "
DIFFERENT_COUNT = " 个差异维度 vs "
SAME_COUNT = " 个相同维度，排名第 "
SCORE_GAP = "（综合分差 "
CLOSE = "）"
KNOWN = "匹配到知识库中的 "
KNOWN_END = " 模式"
DIM_SUBSYSTEM = "子系统"
DIM_BUG_TYPE = "Bug类型"
DIM_FIX = "修复方法"
DIM_VERSION = "内核版本"
DIM_REASONS = "匹配原因"
NOTHING = "无"
COMMON = "\n  共同:   "

# The rule-based explanation for a missing model.
RULES_NONE = """## 分析结果

未能找到匹配的补丁。

### 建议
1. 使用 drgn 分析 vmcore 以获取更多证据
2. 扩大搜索范围，检查相关子系统的最新 commit
3. 检查内核邮件列表中是否有相关讨论
"""
RULES_HEAD = """## 🤖 注意: 当前为规则引擎生成的降级报告

LLM 服务未连接，以下分析基于专家规则和检索指标自动生成。
启用 LLM (Ollama 或 API Key) 可获得更详细的分析报告。

---

## (1) Crash Summary
"""
RULES_CAUSE = "**根因类型**: "
RULES_SUBSYSTEM = "**受影响子系统**: `"
RULES_CONFIDENCE = "**置信度**: "
RULES_EVIDENCE = "\n## (2) 根因证据\n"
RULES_KEYWORD = "- **Panic 关键词**: "
RULES_ADDRESS = "- **故障地址**: `"
RULES_RULE = "- **匹配规则**: "
RULES_FUNCTIONS = "- **调用栈函数**: "
RULES_PATCHES = "\n## (3) 推荐补丁\n\n| Rank | Score | Commit | Subject |\n|------|-------|--------|---------|"
RULES_SCORES = "\n## (4) 评分构成 (Top-1)\n\n| Dimension | Weight | Score | Contribution |\n|-----------|--------|-------|-------------|"
RULES_REASONS = "\n## (5) 排序理由\n"
RULES_MATCH = "- 匹配理由: "
RULES_DIFFERENCE = "- 与 Top1 的差异: "
RULES_PLACE = "- 排名原因: "
RULES_LIMITS = "\n## (6) ⚠️ 分析局限性\n\n以下关键证据缺失: **"
RULES_LIMITS_END = "**\n\n当前推荐应视为**候选补丁排序**，而非确认修复方案。\n建议补充 "
RULES_LIMITS_CLOSE = " 信息后重新分析以获得更准确的结果。"
RULES_DECISION = "\n## (7) 💡 决策建议\n\n**推荐操作**: 优先应用 Top1 补丁 `"
RULES_WHY = "\n**推荐理由**:\n- 综合评分最高 ("
RULES_BY_RULE = "- 匹配了 Expert Rule "
RULES_KIND = "- 修复类型 ("
RULES_KIND_MIDDLE = ") 与根因 ("
RULES_KIND_END = ") 一致"
RULES_CLOSE_RACE = "- ⚠️ 与 Top2 差距极小 ("
RULES_CLOSE_RACE_END = ")，建议同时审查 Top2"
RULES_CLEAR = "- 与 Top2 差距为 "
RULES_CLEAR_END = "，Top1 优势明确"
RULES_STEPS = """
### 建议调查流程

| 步骤 | 操作 | 目的 |
|------|------|------|
| ① | 审查 Top1 的 Diff | 理解具体修复方式 |
| ② | 对比补丁修改函数 vs 崩溃调用栈 | 确认修复是否覆盖崩溃路径 |
| ③ | 检查内核版本兼容性 | 确认补丁可直接 backport |
| ④ | 在测试环境验证补丁 | 确认无回归问题 |
| ⑤ | 合入生产内核 | — |"""
RULES_RISK = "\n### ⚠️ 风险提示\n\n当前分析缺少以下关键证据: **"
RULES_RISK_END = "**。\n因此 Top1 推荐应视为**候选补丁排序**中的最佳候选，而非已确认的修复方案。\n建议补充 "
RULES_RISK_CLOSE = " 信息后重新分析，以获得更高可信度的推荐。"
RULES_TRUST = "\n### ✅ 可信度评估\n\n当前分析的关键证据基本齐全，Top1 推荐可信度较高。\n但仍建议在测试环境验证后再合入生产内核。"
RULES_SCOPE = """
---
> **Analysis Scope**
> 本报告采用 Evidence-Aware 分析策略，所有结论均基于当前输入的宕机日志、
> 结构化分析结果、检索到的补丁信息及其 Diff 内容生成。
> 对于日志中未提供或证据不足的信息，报告已明确标记为 **Unknown**
> 或 **Insufficient Evidence**，未进行推测性补全。"""
