"""Types of parsed pages and of the result store."""

from __future__ import annotations

from pyspark.sql import types as T

S, A = T.StringType(), T.ArrayType
NAMED = T.StructType().add("text", S).add("labelled", "boolean")

PARSED = (
    T.StructType()
    .add("title", S).add("title_source", S).add("description", S).add("keywords", S).add("robots", S).add("canonical", S).add("sitemap", S)
    .add("favicon", S).add("viewport", S).add("webmanifest", S).add("charset", S)
    .add("generators", A(S)).add("scripts", A(S)).add("styles", A(S))
    .add("og_tags", T.MapType(S, S)).add("twitter_tags", T.MapType(S, S))
    .add("images", A(T.StructType().add("src", S).add("alt", S).add("srcset", S)))
    .add("hrefs", A(S)).add("headings", A(T.StructType().add("tag", S).add("text", S).add("source", S)))
    .add("anchors", A(NAMED)).add("buttons", A(NAMED))
    .add("fields", A(S)).add("label_for", A(S)).add("ids", A(S)).add("frames", A(S)).add("tabindexes", A(S))
    .add("roles", A(T.StructType().add("role", S).add("attrs", A(S))))
    .add("html_has_lang", "boolean").add("bare_aria", "boolean")
)

SITE = T.StructType().add("id", "integer").add("name", S).add("url", S).add("created_at", "timestamp")
SITE_RUN = T.StructType().add("id", "integer").add("site_id", "integer").add("created_at", "timestamp").add("status", S)
SITE_PAGE = T.StructType().add("id", "long").add("site_id", "integer").add("site_run_id", "integer").add("url", S).add("db_link_type", S).add("created_at", "timestamp")
PAGE_RULE_RESULT = T.StructType().add("id", "long").add("site_page_id", "long").add("site_run_id", "integer").add("url", S).add("rule_id", S).add("passed", "boolean").add("created_at", "timestamp")
PLUGIN_RULE = (
    T.StructType().add("id", S).add("name", S).add("plugin_name", S).add("description", S).add("severity", S).add("category", S)
    .add("rule_type", S).add("passed_message", S).add("failed_message", S).add("enabled", "boolean")
)
STORED_RULE = T.StructType([*PLUGIN_RULE.fields]).add("created_at", "timestamp").add("updated_at", "timestamp")
#: What batches change in the reports of a run, and how far its parts are.
CATEGORY_COUNT = T.StructType().add("site_run_id", "integer").add("category", S).add("batch", S).add("total", "long").add("passed", "long").add("failed", "long")
LINK_COUNT = T.StructType().add("site_run_id", "integer").add("db_link_type", S).add("batch", S).add("count", "long")
RUN_PROGRESS = (
    T.StructType().add("site_run_id", "integer").add("part", "integer").add("total_pages", "long").add("completed_pages", "long").add("started", "boolean")
    .add("finished", "boolean").add("last_seq", "long").add("kind", S).add("url", S)
)
TABLES = {
    "site": SITE, "site_run": SITE_RUN, "site_page": SITE_PAGE, "page_rule_result": PAGE_RULE_RESULT, "plugin_rule": STORED_RULE,
    "category_count": CATEGORY_COUNT, "link_count": LINK_COUNT, "run_progress": RUN_PROGRESS,
}

LINK_TYPES = ["Internal", "External", "Mailto", "Tel", "Unknown"]
RUN_STATUSES = ["Pending", "Running", "Finished", "Error"]
SEVERITIES = ["Info", "Warning", "Error", "Critical"]
CATEGORIES = ["Accessibility", "Performance", "BestPractices", "SEO"]
