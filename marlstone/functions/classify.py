"""Ladders, validators and look-ups: kinds of questions, tags, files and contents as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import stripped

# Words that tell the intent of a question, with their confidences, in this order.
INTENTS = (
    ("factual_qa", 0.8, "什么 是什么 what".split()),
    ("operation_guide", 0.8, "如何 怎么 how".split()),
    ("comparison_analysis", 0.7, "比较 对比 compare".split()),
)
DEFAULT_INTENT = ("factual_qa", 0.5)

# Words of the kinds of questions about code, sure ones and weak ones.
SURE_WORDS = {
    "call_chain": ["调用链", "调用路径", "call chain", "call path", "调用关系", "被哪些地方调用"],
    "diagram": ["绘制", "生成", "逻辑图", "架构图", "流程图", "diagram", "chart", "图表"],
    "architecture": ["系统架构", "架构设计", "architecture", "系统结构", "模块关系"],
    "understanding": ["这个函数", "这个类", "这段代码", "做什么", "是什么", "如何工作"],
    "best_practice": ["有什么问题", "如何优化", "改进建议", "最佳实践", "代码质量"],
}
WEAK_WORDS = {
    "call_chain": ["调用", "call", "invoke", "被调用", "调用者"],
    "architecture": ["架构", "结构", "模块", "设计", "组织"],
    "understanding": ["什么", "如何", "为什么", "what", "how", "why", "解释"],
    "best_practice": ["问题", "优化", "建议", "issue", "optimize", "改进"],
}

# Tags of the system, words of generated tags, colours.
SYSTEM_TAGS = "技术 产品 文档 API 手册 用户指南 开发 测试 部署".split()
GENERATED_TAG_WORDS = "自动 生成 推荐 智能".split()
TAG_COLOURS = {"技术": "#409eff", "产品": "#67c23a", "文档": "#e6a23c", "API": "#f56c6c", "手册": "#909399"}
PLAIN_COLOUR = "#909399"

# Words of statements and of particulars, by which answers are taken for accurate.
STATEMENT_WORDS = "是 不是 有 没有 可以 不能 应该 不应该".split()
PARTICULAR_WORDS = "具体 详细 例如 比如 包括 包含".split()

# Extensions of files that are taken, with their media types.
MEDIA_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".txt": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown", ".html": "text/html", ".htm": "text/html",
    ".csv": "text/csv", ".json": "application/json", ".xml": "application/xml",
}
# What contents of files may not hold.
SUSPICIOUS = (
    "javascript: eval( exec( atob( document.write innerhtml powershell invoke-expression downloadstring wscript.shell creatobject "
    "activexobject shell.exec shell.run automation shell32 wscript system( cmd.exe /bin/sh /bin/bash fromchar unescape decodeuricomponent"
).split() + ["union select", "drop table", ";--"]
# Folders that are left out, marks of built and minified files.
IGNORED_FOLDERS = "node_modules dist build __pycache__ .git venv env .venv target out .next coverage .pytest_cache .mypy_cache".split()
MINIFIED_MARKS = "_next/static/chunks /dist/ /build/ .min.js .bundle.js .chunk.js".split()

# Extensions and file names of languages; of languages that share one the first counts.
LANGUAGES = {
    "python": ".py .pyw .pyi", "javascript": ".js .jsx .mjs .cjs", "typescript": ".ts .tsx", "java": ".java",
    "php": ".php .phtml .php3 .php4 .php5 .phps", "ruby": ".rb .rake .rbw .gemspec", "c": ".c .h",
    "cpp": ".cpp .cc .cxx .c++ .hpp .hh .hxx .h++ .h", "csharp": ".cs", "go": ".go", "rust": ".rs", "swift": ".swift",
    "kotlin": ".kt .kts", "scala": ".scala .sc", "html": ".html .htm .xhtml", "css": ".css .scss .sass .less", "json": ".json",
    "yaml": ".yaml .yml", "xml": ".xml", "markdown": ".md .markdown", "bash": ".sh .bash", "shell": ".sh .bash .zsh .fish",
    "sql": ".sql", "dockerfile": "Dockerfile .dockerfile", "makefile": "Makefile makefile .mk",
}

# What each role may do.
ROLES = {
    "owner": "kb:view kb:edit kb:delete kb:manage_members doc:view doc:upload doc:edit doc:delete kg:view kg:edit kg:extract kg:delete".split(),
    "admin": "kb:view kb:edit kb:manage_members doc:view doc:upload doc:edit doc:delete kg:view kg:edit kg:extract kg:delete".split(),
    "editor": "kb:view doc:view doc:upload doc:edit doc:delete kg:view kg:edit kg:extract".split(),
    "viewer": "kb:view doc:view kg:view".split(),
}

# What an address, a mobile number and a URL look like.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^1[3-9]\d{9}$"
URL = r"^https?://([-\w.])+(:[0-9]+)?(/([\w/_.])*(\?([\w&=%.])*)?(#([\w.])*)?)?$"


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words the text holds."""
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def intent(text: Column) -> tuple[Column, Column]:
    """(kind, confidence) of a question, by the first kind of which it has a word."""
    low = F.lower(text)
    kind, sure = F.lit(DEFAULT_INTENT[0]), F.lit(DEFAULT_INTENT[1])
    for name, confidence, words in reversed(INTENTS):
        kind = F.when(has_any(low, words), name).otherwise(kind)
        sure = F.when(has_any(low, words), confidence).otherwise(sure)
    return kind, sure


def fused_intent(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """The kind both agree on, or that of the one that is surer (the second if neither is), and the larger confidence."""
    return F.when((a[0] == b[0]) | (a[1] > b[1]), a[0]).otherwise(b[0]), F.greatest(a[1], b[1])


def best_category(text: Column, words: dict[str, list[str]]) -> Column:
    """A struct of category, confidence (.5 + .1 a hit, .9 at most): most hits, of equals the first listed; null without a hit."""
    low = F.lower(text)
    scored = [F.struct(hits(low, w).alias("hits"), F.lit(-k).alias("place"), F.lit(name).alias("category")) for k, (name, w) in enumerate(words.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["hits"] > 0, F.struct(best["category"].alias("category"), F.least(F.lit(0.9), 0.5 + 0.1 * best["hits"]).alias("confidence")))


def question_kind(text: Column) -> Column:
    """Category of a question: sure words from confidence .9, weak words above .6, else general."""
    sure, weak = best_category(text, SURE_WORDS), best_category(text, WEAK_WORDS)
    return F.when(sure["confidence"] >= 0.9, sure["category"]).when(weak["confidence"] > 0.6, weak["category"]).otherwise("general")


def tag_kind(tag: Column) -> Column:
    return F.when(tag.isin(SYSTEM_TAGS), "system").when(has_any(tag, GENERATED_TAG_WORDS), "auto").otherwise("user")


def tag_colour(tag: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TAG_COLOURS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, tag), F.lit(PLAIN_COLOUR))


def accuracy(content: Column) -> Column:
    """Indicator words that the content has, a tenth each, 1 at most."""
    return F.least(hits(content, STATEMENT_WORDS + PARTICULAR_WORDS) / 10.0, F.lit(1.0))


def completeness(content: Column) -> Column:
    """Mean of the length in 500 characters and of full stops in threes, 1 at most each."""
    stops = F.regexp_count(content, F.lit("[.。]"))
    return (F.least(F.length(content) / 500.0, F.lit(1.0)) + F.least(stops / 3.0, F.lit(1.0))) / 2


def extension(path: Column) -> Column:
    """With its full stop, lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def media_type(path: Column) -> Column:
    """Null for files that are not taken."""
    table = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.try_element_at(table, extension(path))


def suspicious_words(content: Column) -> Column:
    low = F.lower(content)
    return F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in SUSPICIOUS]))


def is_minified(path: Column) -> Column:
    return has_any(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), MINIFIED_MARKS)


def is_ignored(path: Column) -> Column:
    """Whether a folder of the path is left out."""
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*map(F.lit, IGNORED_FOLDERS)))


def code_language(path: Column) -> Column:
    """By file name, then extension; null for other files."""
    pairs: dict[str, str] = {}
    for name, keys in LANGUAGES.items():
        for key in keys.split():
            pairs.setdefault(key, name)
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.substring_index(path, "/", -1)), F.try_element_at(table, extension(path)))


# Names of entry, build and documentation files, words of other paths, with the scores of files.
ENTRY_WORDS = "main. app. index. server. manage.py __main__".split()
BUILD_WORDS = "package.json requirements.txt pyproject.toml setup.py pom.xml build.gradle dockerfile makefile go.mod cargo.toml".split()
DOC_WORDS = ["docs/", "doc/"]


def file_importance(path: Column) -> tuple[Column, Column]:
    """(kind, score) of a file by its path: readme 10, entry 9, build 8, config 7, core and doc 6, test 3, others 1."""
    low, name = F.lower(path), F.lower(F.substring_index(path, "/", -1))
    ladder = (
        ("readme", 10, name.contains("readme")), ("entry", 9, has_any(name, ENTRY_WORDS)), ("build", 8, has_any(low, BUILD_WORDS)),
        ("config", 7, has_any(low, ["config", "setting"])), ("core", 6, has_any(low, ["core", "main", "base", "common"])),
        ("doc", 6, has_any(low, DOC_WORDS) | name.rlike(r"\.(md|rst|txt|adoc)$")), ("test", 3, has_any(low, ["test", "spec"])),
    )
    kind, score = F.lit(None).cast("string"), F.lit(1)
    for k, s, holds in reversed(ladder):
        kind, score = F.when(holds, k).otherwise(kind), F.when(holds, s).otherwise(score)
    return kind, score


def role(member_role: Column, is_member: Column, is_owner: Column) -> Column:
    """The member's role (viewer where none is given), else owner, else null."""
    return F.when(is_member, F.coalesce(member_role, F.lit("viewer"))).when(is_owner, "owner")


def may(role_name: Column, action: str) -> Column:
    return F.coalesce(role_name.isin([r for r, actions in ROLES.items() if action in actions]), F.lit(False))


def content_issues(text: Column, least: int = 1, most: int = 1_000_000, newlines: float = 0.5, special: float = 0.1) -> Column:
    """What is wrong with a content, in this order; an empty array if nothing is."""
    n = F.length(text)
    odd = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}_\s.,!?;:()\[\]{}\"'-]"))
    return F.array_compact(
        F.array(
            F.when(n < least, "too_short"), F.when(n > most, "too_long"), F.when((n > 0) & (stripped(text) == ""), "blank"),
            F.when(F.regexp_count(text, F.lit("\n")) > n * newlines, "newlines"), F.when(odd > n * special, "special_characters"),
        )
    )


def is_email(x: Column) -> Column:
    return F.coalesce(x.rlike(EMAIL), F.lit(False))


def is_phone(x: Column) -> Column:
    return F.coalesce(x.rlike(PHONE), F.lit(False))


def is_url(x: Column) -> Column:
    return F.coalesce(x.rlike(URL), F.lit(False))


def has_length(x: Column, least: int = 0, most: int = 1000) -> Column:
    """Null passes where nothing is required."""
    return F.coalesce(F.length(x).between(least, most), F.lit(least == 0))


def in_range(x: Column, least: float, most: float) -> Column:
    return F.coalesce(x.between(least, most), F.lit(False))


def missing_fields(fields: list[str]) -> Column:
    """Names of the columns that are null or empty."""
    return F.array_compact(F.array(*[F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f)) for f in fields]))


def is_vector(v: Column) -> Column:
    """Not empty, all numbers, not all zero."""
    return F.coalesce((F.size(v) > 0) & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double"))), F.lit(False))


def structured_kind(path: Column, head: Column) -> Column:
    """json, xml, csv or null, by extension, or for .txt by the first kilobyte."""
    ext, text = extension(path), stripped(F.substring(head, 1, 1024))
    is_json = text.rlike(r"^[{\[]") & F.try_parse_json(text).isNotNull()
    read = F.from_xml(text, "_corrupt_record string", {"mode": "PERMISSIVE"})
    is_xml = text.startswith("<") & read.isNotNull() & read["_corrupt_record"].isNull()
    return (
        F.when(ext == ".json", "json").when(ext == ".xml", "xml").when(ext.isin(".csv", ".xlsx", ".xls"), "csv")
        .when((ext == ".txt") & is_json, "json").when((ext == ".txt") & is_xml, "xml")
    )


def should_retry(count: Column, last: Column, now: Column, most: int, minutes: int) -> Column:
    """Whether a failed task is tried again: tries are left, and the last is long enough ago or never was."""
    waited = last.isNull() | (now >= last + F.make_dt_interval(mins=F.lit(minutes)))
    return (F.coalesce(count, F.lit(0)) < most) & waited
