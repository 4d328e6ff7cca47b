"""Rule tables of the news domain. They must equal those that readers of the archive rely on."""

from __future__ import annotations

CATEGORY_KEYWORDS = {
    "agent": ["agent", "agentic", "multi-agent", "智能体", "mcp", "tool use", "computer use", "workflow"],
    "benchmark": ["benchmark", "leaderboard", "evaluation", "evals", "arena", "基准", "评测", "榜单", "score"],
    "release": ["release", "launch", "introducing", "announce", "unveil", "open source", "weights", "发布", "开源", "模型上线"],
    "industry": ["enterprise", "customer", "deploy", "production", "business", "industry", "adoption", "应用", "落地", "企业"],
}
CATEGORY_TAG = {"industry": "行业应用", "agent": "Agent", "release": "模型发布", "benchmark": "Benchmark"}
TAG_PATTERNS = {
    "OpenAI": r"\bopenai\b", "GPT": r"\bgpt(?:-?\d[\w.-]*)?\b", "Anthropic": r"\banthropic\b", "Claude": r"\bclaude\b", "Google": r"\bgoogle\b",
    "Gemini": r"\bgemini\b", "Meta": r"\bmeta\b", "Llama": r"\bllama\b", "Microsoft": r"\bmicrosoft\b", "Qwen": r"\bqwen\b|通义千问",
    "DeepSeek": r"\bdeepseek\b", "Mistral": r"\bmistral\b", "Agent": r"\bagents?\b|智能体", "MCP": r"\bmcp\b|model context protocol",
    "RAG": r"\brag\b|retrieval.augmented", "开源": r"open.source|open weights|开源", "多模态": r"multimodal|多模态",
    "推理": r"reasoning|inference|推理", "Benchmark": r"benchmark|leaderboard|arena|评测|榜单",
}
SIGNAL_WORDS = ["release", "launch", "benchmark", "发布", "开源"]
NOISE_PHRASES = ["accept cookies", "all rights reserved", "cookie policy", "enable javascript", "privacy policy", "sign in", "sign up", "sponsored by", "subscribe to", "terms of use", "use cookies", "版权所有", "登录后", "隐私政策"]
#: Secrets stand where no letter or digit touches them (what may touch on either side differs by kind).
SECRETS = [
    (r"(?<![A-Za-z0-9])hf_[A-Za-z0-9]{20,}(?![A-Za-z0-9])", "hf_[REDACTED]"),
    (r"(?<![A-Za-z0-9])github_pat_[A-Za-z0-9_]{20,}(?![A-Za-z0-9_])", "github_pat_[REDACTED]"),
    (r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{20,}(?![A-Za-z0-9])", "gh_[REDACTED]"),
    (r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])", "sk-[REDACTED]"),
    (r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])", "AIza[REDACTED]"),
    (r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])", "AKIA[REDACTED]"),
]
#: Most points of a review's dimension, words a review may use.
DIMENSION_LIMITS = {"relevance": 25, "impact": 25, "novelty": 15, "credibility": 15, "usefulness": 10, "timeliness": 10}
EVIDENCE = ["clear", "partial", "none"]
INFORMATION = ["original", "analysis", "rehash", "rumor"]
CATEGORIES = ["industry", "agent", "release", "benchmark"]
COMMUNITY = ["reddit", "linux do", "linux.do"]
DEFAULT_SUMMARY = "来自原始信息源的最新动态，点击标题查看完整内容。"
DIMENSIONS = ["relevance", "impact", "novelty", "credibility", "usefulness", "timeliness"]
LEVEL_STEPS = [(85, 5), (70, 4), (50, 3), (30, 2)]
