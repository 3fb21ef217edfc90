"""Escaping, redaction and small renderings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def redact(text: Column, secrets: list[str]) -> Column:
    for s in secrets:
        if s:
            text = F.replace(text, F.lit(s), F.lit("[REDACTED]"))
    return text


def redact_failure(text: Column) -> Column:
    """URL queries, bearer tokens, named secrets and absolute paths; a URL's closing punctuation stays."""
    text = F.regexp_replace(text, r"(?i)\b(https?://[^\s<>\"'?#]+)\?[^\s<>\"']*?([),.;!?]*)(?=[\s<>\"']|$)", "$1?[REDACTED]$2")
    text = F.regexp_replace(text, r"(?i)\bBearer\s+[^\s,;]+", "Bearer [REDACTED]")
    text = F.regexp_replace(text, r"(?i)\b(authorization|(?:notion[_-]?)?token|api[_-]?key|signature|x-amz-signature)\b\s*[:=]\s*[^\s,;]+", "$1=[REDACTED]")
    text = F.regexp_replace(text, r"(?i)\b[A-Z]:\\[^\s,;]+", "[REDACTED_PATH]")
    return F.regexp_replace(text, r"(^|[\s('\"`])/(?!/)[^\s,;)]+", "$1[REDACTED_PATH]")


def redact_value(key: Column, value: Column) -> Column:
    """A log field: secrets by name, queries of URLs."""
    url = value.rlike(r"(?i)^[a-z][a-z0-9+.-]*://\S+$")
    return F.when(key.rlike("(?i)authorization|token"), "[REDACTED]").when(url, F.regexp_replace(value, r"\?[^#]+", "?[REDACTED]")).otherwise(value)


def inline(text: Column) -> Column:
    text = F.trim(F.regexp_replace(text, r"[\r\n]+", " "))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def table_cell(text: Column) -> Column:
    return F.replace(inline(text), F.lit("|"), F.lit("\\|"))


def wiki_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"(?i)\.md\z", "")


def index_path(path: Column) -> Column:
    return F.replace(wiki_path(path), F.lit("]"), F.lit("\\]"))


def index_alias(text: Column) -> Column:
    return F.replace(table_cell(text), F.lit("]"), F.lit("\\]"))


def wiki_alias(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")), F.lit("]"), F.lit("\\]"))


def wiki_link(path: Column, label: Column, in_table: Column) -> Column:
    bare = wiki_path(path)
    last = F.substring_index(bare, "/", -1)  # a pattern that ends the text would try each place before the last slash
    name = F.coalesce(F.nullif(F.trim(label), F.lit("")), F.nullif(last, F.lit("")), bare)
    return F.concat(F.lit("[["), bare, F.when(in_table, "\\|").otherwise("|"), wiki_alias(name), F.lit("]]"))


def comment_safe(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("--"), F.lit("-")), F.lit(">"), F.lit(""))


def placeholder(kind: Column, ident: Column, owner: str = "foliate") -> Column:
    k, i = comment_safe(kind), comment_safe(ident)
    return F.concat(F.lit("[Unsupported block: "), k, F.lit(f"]\n<!-- {owner}: unsupported block type="), k, F.lit(" id="), i, F.lit(" -->"))


def attribute(tag: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag, rf"(?:^|\s){name}\s*=\s*([\"'])(.*?)\1", 2), F.lit(""))


def escape_cell(text: Column) -> Column:
    """Line breaks become tags; a bar is escaped unless an odd number of backslashes does so already."""
    text = F.regexp_replace(text, r"\r?\n", "<br>")
    return F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\|", "$1\\\\|")


def table_text(rows: Column, header: Column) -> Column:
    """An array of rows of cells as a table; without a header row its cells are empty."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, escape_cell), " | "), F.lit(" |"))
    first = F.get(rows, F.lit(0))
    head = F.when(header, first).otherwise(F.transform(first, lambda _: F.lit("")))
    body = F.when(header, F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))).otherwise(rows)
    return F.array_join(F.concat(F.array(line(head), line(F.transform(head, lambda _: F.lit("---")))), F.transform(body, line)), "\n")


def rich_text(parts: Column) -> Column:
    """An array of ``plain, code, bold, italic, strike, href`` as Markdown, marks nested in this order."""
    def one(p: Column) -> Column:
        text = F.coalesce(p["plain"], F.lit(""))
        for field, mark in (("code", "`"), ("bold", "**"), ("italic", "*"), ("strike", "~~")):
            text = F.when(F.coalesce(p[field], F.lit(False)), F.concat(F.lit(mark), text, F.lit(mark))).otherwise(text)
        return F.when(F.coalesce(p["href"], F.lit("")) != "", F.concat(F.lit("["), text, F.lit("]("), p["href"], F.lit(")"))).otherwise(text)

    return F.array_join(F.transform(parts, one), "")


def block_line(kind: Column, text: Column, checked: Column, language: Column, url: Column, ident: Column, owner: str = "foliate") -> Column:
    """A flat block as Markdown."""
    put = lambda before, after="": F.concat(F.lit(before), text, F.lit(after))
    return (
        F.when(kind == "paragraph", text).when(kind == "heading_1", put("# ")).when(kind == "heading_2", put("## ")).when(kind == "heading_3", put("### "))
        .when(kind == "bulleted_list_item", put("- ")).when(kind == "numbered_list_item", put("1. "))
        .when(kind == "to_do", F.concat(F.when(F.coalesce(checked, F.lit(False)), "- [x] ").otherwise("- [ ] "), text))
        .when(kind == "quote", F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> ")))).when(kind == "divider", "---")
        .when(kind == "code", F.concat(F.lit("```"), F.coalesce(language, F.lit("")), F.lit("\n"), text, F.lit("\n```")))
        .when((kind == "image") & url.isNotNull(), F.concat(F.lit("!["), text, F.lit("]("), url, F.lit(")")))
        .when((kind == "file") & url.isNotNull(), F.concat(F.lit("["), F.coalesce(F.nullif(text, F.lit("")), F.lit("File")), F.lit("]("), url, F.lit(")")))
        .when((kind == "equation") & (text != ""), put("$$\n", "\n$$")).when(kind == "table_row", "")
        .otherwise(placeholder(kind, ident, owner))
    )


def marker(content: Column, owner: str = "foliate") -> Column:
    """``id, content_hash`` of a file that is managed, null for others."""
    head = F.regexp_extract(content, r"(?s)^---\n(.*?)\n---\n", 1)
    key = lambda k: F.nullif(F.regexp_extract(head, rf"(?m)^{k}:[ ]*[\"']?([^\"'\n]*?)[\"']?[ ]*$", 1), F.lit(""))
    ok = (key("managed_by") == owner) & key("notion_id").rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return F.when(ok, F.struct(key("notion_id").alias("id"), key("content_hash").alias("content_hash")))


def body(content: Column) -> Column:
    """What follows the front matter; null without one."""
    return F.when(content.rlike(r"(?s)^---\n.*?\n---\n"), F.regexp_replace(content, r"(?s)\A---\n.*?\n---\n", ""))


def error_category(status: Column) -> Column:
    return F.when(status == 401, "authentication").when(status.isin(403, 404), "permission").when(status == 400, "validation").when(status == 429, "rate_limited").when(status >= 500, "service_unavailable").otherwise("network")


def retryable(status: Column, code: Column) -> Column:
    codes = ["ECONNRESET", "ETIMEDOUT", "ECONNABORTED", "notionhq_client_request_timeout"]
    return F.coalesce(status.isin(429, 529, 500, 502, 503, 504), F.lit(False)) | F.coalesce(code.isin(codes), F.lit(False))


def retry_delay(attempt: Column, retry_after: Column, random: Column, base_ms: int = 500, most_ms: int = 30_000) -> Column:
    """Milliseconds: what the server asks for, else doubling from the base, up to the maximum, times a half to one."""
    asked = retry_after.try_cast("double")
    return F.when(asked >= 0, asked * 1000).otherwise(F.least(F.lit(float(most_ms)), base_ms * F.pow(F.lit(2.0), attempt - 1)) * (0.5 + random / 2))


def exit_code(kind: Column, message: Column, ok: Column, flags: dict[str, Column]) -> Column:
    """0 to 5 from an error's kind, or a result's flags."""
    safety = kind == "safety"
    return (
        F.when(safety & message.rlike("(?i)lock"), 5).when(safety, 3).when(kind.isNotNull(), 1)
        .when(ok.isNull() | (~ok & flags["lock_failed"]), 5).when(~ok & flags["verify_mismatch"], 4).when(~ok & flags["safety_stopped"], 3).when(~ok & flags["partial"], 2)
        .when(ok, 0).otherwise(1)
    )


def sync_mode(page: Column, root: Column, full: Column) -> Column:
    return F.when(page.isNotNull(), "page").when(root.isNotNull(), "root").when(full, "full").otherwise("incremental")
