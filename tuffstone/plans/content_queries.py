"""Queries of the content scanners over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuffstone.functions import text
from tuffstone.operators import credentials, licenses, secrets
from tuffstone.runtime import table

USER_RULES = """{"content_rules": [{"type": "kernel-option", "anchors": ["CONFIG_"], "regex": "CONFIG_([A-Z0-9_]+)", "description": "kernel option"},
 {"type": "advisory-ref", "anchors": ["CVE-"]}], "path_rules": [{"glob": "**/*.lock", "type": "lock-file"}, {"glob": "usr/**/*.so", "type": "shared-object"}]}"""


def source_tree(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_files").select(F.concat_ws("/", F.lit("repo"), "repo_id", "path").alias("path"), "content")


def document_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.col("text").alias("content"))


def basename_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "components").where("origin_path is not null").groupBy(text.basename(F.col("origin_path")).alias("name")).agg(F.count("*").alias("n"))


def owning_roots(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "components")
    return c.groupBy(text.owning_root(F.col("origin_path"), "status").alias("root")).agg(F.count("*").alias("n"))


def glob_match(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "source_files").select("path").union(table(spark, sf, "components").select("origin_path")).where("path is not null").distinct()
    return p.select("path", *[F.col("path").rlike(text.glob_regex(g)).alias(n) for n, g in (("any_c", "**/*.c"), ("one_deep", "*/*"), ("under_lib", "usr/lib/**"), ("four", "????*"))])


def path_rules(spark: SparkSession, sf: str) -> DataFrame:
    _, paths = secrets.user_rules(USER_RULES)
    files = table(spark, sf, "components").select(F.col("origin_path").alias("path")).where("path is not null")
    return secrets.notable_paths(files, secrets.PATH_RULES + paths).groupBy("glob", "category", "type").agg(F.count("*").alias("n"))


def redact_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "findings").where("evidence is not null").groupBy(text.redact(F.col("evidence")).alias("label")).agg(F.count("*").alias("n"))


def placeholder_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    return d.groupBy(text.is_placeholder(F.col("text")).alias("placeholder")).agg(F.count("*").alias("n"))


def token_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "findings").where("label is not null").select("finding_id", F.round(text.entropy(F.col("label")), 6).alias("entropy"))


def crc_token_check(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "components").where("purl is not null").select("comp_id", text.base62_checksum(F.col("purl")).alias("checksum"))


TOKENS = ["eyJhbGciOiJIUzI1NiJ9.eyJleHAiOjE3MDAwMDAwMDB9.c2ln", "eyJhbGciOiJub25lIiwidHlwIjoiSldUIn0.eyJzdWIiOiJhIn0.x", "bm90IGpzb24.bm90IGpzb24.z", "a.b"]


def jwt_fields(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.createDataFrame([(i, x) for i, x in enumerate(TOKENS)], "n int, token string")
    return t.select("n", text.jwt_fields(F.col("token"), F.lit(1750000000)).alias("j")).select("n", "j.ok", "j.alg", "j.exp", "j.expired")


def rule_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Built-in rules over all source files and documents."""
    return secrets.scan_secrets(source_tree(spark, sf).unionByName(document_files(spark, sf)))


def user_rule_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rules, _ = secrets.user_rules(USER_RULES)
    return secrets.scan_secrets(document_files(spark, sf), rules).where("type = 'kernel-option'").groupBy("label").agg(F.count("*").alias("n"))


def rule_hits_by_source(spark: SparkSession, sf: str) -> DataFrame:
    rules, _ = secrets.user_rules(USER_RULES)
    hits = secrets.scan_secrets(document_files(spark, sf), rules)
    return hits.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("source"), "type").agg(F.count("*").alias("n"))


def finding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "findings").select(F.col("file_id").alias("path"), F.col("byte_offset").alias("offset"), F.col("byte_size").alias("size"), "type", "confidence", "label")
    return secrets.dedup_findings(f.where("confidence is not null")).groupBy("type").agg(F.count("*").alias("n"), F.sum("confidence").alias("total"))


def severity_rollup(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "findings").rollup("category", "type").agg(F.count("*").alias("n"), F.max("confidence").alias("best"), F.grouping_id().alias("level"))
    return f.select("category", "type", "n", "best", F.col("level").cast("bigint").alias("level"))


def collapse_findings(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "findings")
    return f.groupBy("type", "label").agg(F.count("*").alias("times"), F.min("file_id").alias("first_file"))


def license_tags(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "source_files")
    return s.select("file_id", F.explode(licenses.spdx_tags(F.col("content"))).alias("license"))


def license_docs(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "source_files").select(F.col("file_id").alias("id"), F.col("content").alias("text"))
    both = s.union(table(spark, sf, "documents").select(-F.col("doc_id"), "text"))
    return both.select("id", F.explode(licenses.text_markers(F.col("text"))).alias("license"))


def license_summary(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_summary(licenses.file_licenses(source_tree(spark, sf)))


def license_paths(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_paths(licenses.file_licenses(source_tree(spark, sf)))


SHADOW = [
    ("etc/shadow", "root:$1$ab$cdefg:1::::\ndaemon:*:1\nempty::1:0\n# note:x\nold:abcdefghijklm:1\nnew:$6$salt$hash:1\nlocked:!$6$a$b:1\nodd:zz:1\n"),
    ("srv/.htpasswd", "ann:$apr1$x$y\nbob:{SHA}zzz=\ncarl:plain\n:nobody\n"),
    ("etc/passwd", "root:x:0:0\n"),
]
CONFIGS = [
    ("etc/user.json", '{"users":[{"name":"a","passwd":"aHVudGVyMg=="},{"name":"b","passwd":"admin"}]}'),
    ("cfg/wifi.json", '{"wifi":{"ssid":"x","psk":"correct horse"}}'),
    ("cfg/lock.json", '{"pin": 8604, "token": 1003}'),
    ("cfg/keys.json", '{"pins":["1"],"pincode":["8604","0000"]}'),
    ("cfg/noise.json", '{"password":"changeme","secret":"short","apikey":true}'),
    ("cfg/bad.json", '{"password": "hunter22"'),
]


def shadow_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.password_files(spark.createDataFrame(SHADOW, "path string, content string"))


def config_credentials(spark: SparkSession, sf: str) -> DataFrame:
    fixed = spark.createDataFrame(CONFIGS, "path string, content string")
    bodies = table(spark, sf, "osv_raw").select(F.concat(F.lit("raw/"), "raw_id").alias("path"), F.col("body").alias("content"))
    return credentials.config_credentials(fixed.unionByName(bodies)).select("path", "type", "confidence", "label")


QUERIES = {
    f.__name__: f
    for f in (
        basename_counts, owning_roots, glob_match, path_rules, redact_labels, placeholder_filter, token_entropy, crc_token_check, jwt_fields, rule_hits, user_rule_tokens, rule_hits_by_source,
        finding_dedup, severity_rollup, collapse_findings, license_tags, license_docs, license_summary, license_paths, shadow_hashes, config_credentials,
    )
}

_TAGS = "select {id} as id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(content, 'SPDX-License-Identifier:[ \\t]*([A-Za-z0-9 .+():_\\-]+)', 1), lambda e: rtrim(e)), lambda e: e <> '' and length(e) <= 128))) as license from source_files"


def _markers(rows: str) -> str:
    has = lambda *m: "(" + " or ".join(f"contains(text, '{x}')" for x in m) + ")"
    gnu3 = f"case when {has('GNU AFFERO GENERAL PUBLIC LICENSE', 'GNU Affero')} then 'AGPL-3.0' when {has('GNU LESSER GENERAL PUBLIC LICENSE', 'Lesser General Public')} then 'LGPL-3.0' else 'GPL-3.0' end"
    tests = [
        (has("Version 3, 29 June 2007"), gnu3),
        (has("Version 2.1, February 1999"), "'LGPL-2.1'"),
        (has("Version 2, June 1991"), f"case when {has('GNU LIBRARY GENERAL PUBLIC LICENSE')} then 'LGPL-2.0' when not {has('GNU LESSER GENERAL PUBLIC LICENSE', 'Lesser General Public')} then 'GPL-2.0' end"),
        (has("Apache License") + " and " + has("Version 2.0"), "'Apache-2.0'"),
        (has("Mozilla Public License Version 2.0"), "'MPL-2.0'"),
        (has("Eclipse Public License"), f"case when {has('v 2.0', 'v. 2.0', 'Version 2.0')} then 'EPL-2.0' else 'EPL-1.0' end"),
        (has("Boost Software License"), "'BSL-1.0'"),
        (has("Permission is hereby granted, free of charge"), "'MIT'"),
        (has("Permission to use, copy, modify, and/or distribute this software"), "'ISC'"),
        (has("This is free and unencumbered software released into the public domain"), "'Unlicense'"),
        (has("CC0 1.0 Universal"), "'CC0-1.0'"),
    ]
    parts = ", ".join(f"case when {t} then {x} end" for t, x in tests)
    return f"select * from (select id, unnest(list_distinct([{parts}])) as license from ({rows})) where license is not null"


_FILE_LICENSES = f"""with l as (
  select id as path, license, 95 as confidence from ({_TAGS.format(id="concat_ws('/', 'repo', repo_id, path)")})
  union all select id as path, license, 80 as confidence from ({_markers("select concat_ws('/', 'repo', repo_id, path) as id, content as text from source_files where regexp_matches(lower(concat_ws('/', 'repo', repo_id, path)), '(^|/)((license|licence|copying|notice|copyright|unlicense|eula)([.][^/]*)?|[^/]*[.]license)(/|$)')")})),
f as (select path, license, max(confidence) as confidence from l group by all)"""
_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ORACLE = {
    "basename_counts": "select regexp_extract(origin_path, '([^/]*)$', 1) as name, count(*) as n from components where origin_path is not null group by 1",
    "owning_roots": "select case when origin_path = 'status' then '' when origin_path like '%/status' then left(origin_path, length(origin_path) - 7) end as root, count(*) as n from components group by 1",
    "glob_match": """select path, path like '%.c' as any_c, regexp_matches(path, '^[^/]*/[^/]*$') as one_deep, path like 'usr/lib/%' as under_lib, regexp_matches(path, '^[^/]{4,}$') as four
      from (select distinct path from (select path from source_files union all select origin_path from components) where path is not null)""",
    "path_rules": """with r("glob", category, type, rx) as (values ('**/*.lock', 'config', 'lock-file', '[.]lock$'), ('usr/**/*.so', 'config', 'shared-object', '^usr/(.*/)?[^/]*[.]so$'), ('**/*.pem', 'crypto', 'pem-file', '[.]pem$'),
      ('**/*.key', 'crypto', 'key-file', '[.]key$'), ('**/shadow', 'credential-file', 'shadow-file', '(^|/)shadow$')) select r."glob" as "glob", r.category as category, r.type as type, count(*) as n from components, r where regexp_matches(origin_path, rx) group by all""",
    "redact_labels": "select case when length(evidence) <= 10 then left(evidence, 3) || '...' else left(evidence, 4) || '...' || right(evidence, 4) end as label, count(*) as n from findings where evidence is not null group by 1",
    "placeholder_filter": "select regexp_matches(lower(text), 'example|sample|changeme|placeholder|your_|yourkey|test_key|notreal|redacted|dummy|xxxxxx|aaaaaa|000000|<your|insert_') as placeholder, count(*) as n from documents where text is not null group by 1",
    "token_entropy": """select finding_id, round(-sum(p * log2(p)), 6) as entropy from (select finding_id, count(*) / max(length(label)) as p from (select finding_id, label, unnest(string_split(label, '')) as c from findings where label is not null) group by finding_id, c) group by finding_id""",
    "jwt_fields": "select * from (values (0, true, 'HS256', 1700000000::bigint, true), (1, true, 'none', null, false), (2, false, null, null, false), (3, false, null, null, false)) t(n, ok, alg, exp, expired)",
    "user_rule_tokens": "select label, count(*) as n from (select unnest(regexp_extract_all(text, 'CONFIG_([A-Z0-9_]+)', 1)) as label from documents) group by 1",
    "rule_hits_by_source": """select source, type, count(*) as n from (select source, 'kernel-option' as type, unnest(regexp_extract_all(text, 'CONFIG_([A-Z0-9_]+)')) as x from documents
      union all select source, 'advisory-ref', unnest(regexp_extract_all(text, 'CVE-')) from documents) group by all""",
    "finding_dedup": "select type, count(*) as n, sum(confidence) as total from (select file_id, byte_offset, type, max(confidence) as confidence from findings where confidence is not null group by all) group by type",
    "severity_rollup": "select category, type, count(*) as n, max(confidence) as best, grouping(category, type) as level from findings group by rollup (category, type)",
    "collapse_findings": "select type, label, count(*) as times, min(file_id) as first_file from findings group by all",
    "license_tags": f"select id as file_id, license from ({_TAGS.format(id='file_id')})",
    "license_docs": _markers("select file_id as id, content as text from source_files union all select -doc_id, text from documents"),
    "license_summary": f"{_FILE_LICENSES} select license, count(*) as n, max(confidence) as confidence, min(path) as first_path from f group by license",
    "license_paths": f"{_FILE_LICENSES} select * from (select license, path, row_number() over (partition by license order by path) as k, count(*) over (partition by license) as n from f) where k <= 20",
    "shadow_hashes": """select * from (values ('etc/shadow', 5::bigint, 'root', 'password-hash', 'md5crypt', true), ('etc/shadow', 34, 'empty', 'empty-password', null, false), ('etc/shadow', 58, 'old', 'password-hash', 'descrypt', true),
      ('etc/shadow', 78, 'new', 'password-hash', 'sha512crypt', false), ('srv/.htpasswd', 4, 'ann', 'htpasswd-hash', 'apr1-md5', true), ('srv/.htpasswd', 18, 'bob', 'htpasswd-hash', 'sha1-base64', true)) t(path, "offset", "user", type, algorithm, weak)""",
    "config_credentials": """select * from (values ('etc/user.json', 'config-password', 80, 'aHVu...Mg== (base64)'), ('cfg/wifi.json', 'config-wifi-key', 60, 'corr...orse'), ('cfg/lock.json', 'config-password', 60, '860...'), ('cfg/keys.json', 'config-password', 60, '860...')) t(path, type, confidence, label)""",
}
