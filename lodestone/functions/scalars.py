"""Scalar functions as column expressions; all stay in the JVM.

Functions that validate return NULL where the input is not acceptable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_id(data: C) -> Column:
    """Identity of bytes: sha256:<hex>."""
    return F.concat(F.lit("sha256:"), F.sha2(_c(data).cast("binary"), 256))


def digest(value: C) -> Column:
    """A qualified digest in lower case; only sha256 with 64 hex digits is known."""
    low = F.lower(_c(value))
    return F.when(F.octet_length(_c(value)).eqNullSafe(71) & _c(value).rlike("\\Asha256:[0-9a-fA-F]{64}\\z"), low)


def path(value: C) -> Column:
    """A relative path with forward slashes and without '.' and empty segments; NULL if empty, absolute, on a drive, or with '..'."""
    p = F.replace(_c(value), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    bad = (p == "") | p.startswith("/") | p.rlike("^[A-Za-z]:") | F.exists(parts, lambda s: s == "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def reference(value: C) -> Column:
    """struct(scheme in lower case, locator), split at the first colon."""
    v = _c(value)
    at = F.instr(v, ":")
    scheme = F.substr(v, F.lit(1), at - 1)
    locator = F.substr(v, at + 1)
    fine = (at > 1) & scheme.rlike(r"\A[A-Za-z0-9+\-._]+\z") & (locator != "")
    return F.when(fine, F.struct(F.lower(scheme).alias("scheme"), locator.alias("locator")))


def file_name(value: C) -> Column:
    return F.regexp_replace(_c(value), "[^A-Za-z0-9._-]", "_")


def env_name(value: C) -> Column:
    return F.translate(F.regexp_replace(_c(value), "[^A-Za-z0-9]", "_"), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def fan_out(hex_digits: C) -> Column:
    """<first two digits>/<all digits>."""
    h = _c(hex_digits)
    return F.concat_ws("/", F.substring(h, 1, 2), h)


def substitute(template: C, values: C) -> Column:
    """Replaces each key of a map, in key order, one after the other, so that later keys see earlier results."""
    pairs = F.array_sort(F.map_entries(_c(values)))
    return F.aggregate(pairs, _c(template), lambda s, e: F.replace(s, e["key"], e["value"]))


def argv(template: C, reference_: C, locator: C, revision: C, destination: C, profile: C) -> Column:
    """A command template's fields filled in: {reference} {locator} {revision} {destination} {profile_<key>}."""
    t = _c(template)
    for name, value in (("reference", reference_), ("locator", locator), ("revision", revision), ("destination", destination)):
        t = F.replace(t, F.lit(f"{{{name}}}"), F.coalesce(_c(value), F.lit("")))
    keys = F.transform_keys(_c(profile), lambda k, _: F.concat(F.lit("{profile_"), k, F.lit("}")))
    return substitute(t, keys)


def env_reference(value: C) -> Column:
    """The name in a value that is exactly ${NAME}."""
    return F.nullif(F.regexp_extract(_c(value), r"\A\$\{([^}]+)\}\z", 1), F.lit(""))


def authority_path(locator: C, authority: C | None = None) -> Column:
    """struct(authority, path), split at the first slash; a configured authority leaves the whole locator as path."""
    v = F.regexp_replace(_c(locator), "^/+", "")
    at = F.instr(v, "/")
    split = F.struct(F.when(at > 0, F.substr(v, F.lit(1), at - 1)).otherwise(v).alias("authority"), F.when(at > 0, F.substr(v, at + 1)).otherwise(F.lit("")).alias("path"))
    if authority is None:
        return split
    return F.when(_c(authority).isNotNull(), F.struct(_c(authority).alias("authority"), v.alias("path"))).otherwise(split)


def lfs_pointer(text: C) -> Column:
    """struct(oid, size) of a large-file pointer: at most 1024 bytes, versioned, sha256."""
    v = _c(text).cast("string")
    oid = F.trim(F.regexp_extract(v, r"(?m)^oid sha256:(.*)$", 1))
    size = F.regexp_extract(v, r"(?m)^size (.*)$", 1)
    fine = (F.octet_length(v) <= 1024) & v.startswith("version https://git-lfs.github.com/spec/") & oid.rlike("\\A[0-9a-fA-F]{64}\\z") & F.trim(size).try_cast("bigint").isNotNull()
    return F.when(fine, F.struct(F.lower(oid).alias("oid"), F.trim(size).try_cast("bigint").alias("size")))


def task_name(target: C) -> Column:
    """Without one leading @, up to the first dot."""
    return F.substring_index(F.regexp_replace(_c(target), "^@", ""), ".", 1)


def assignment(value: C) -> Column:
    """struct(key, value), split at the first equals sign."""
    v = _c(value)
    at = F.instr(v, "=")
    return F.when(at > 0, F.struct(F.substr(v, F.lit(1), at - 1).alias("key"), F.substr(v, at + 1).alias("value")))


def content_range_start(header: C) -> Column:
    return F.nullif(F.regexp_extract(_c(header), r"^bytes (\d+)-", 1), F.lit("")).try_cast("bigint")


def validator(etag: C, last_modified: C) -> Column:
    return F.coalesce(_c(etag), _c(last_modified))


def shell_quote(value: C) -> Column:
    return F.concat(F.lit("'"), F.replace(_c(value), F.lit("'"), F.lit("'\\''")), F.lit("'"))


def shell_join(values: C) -> Column:
    return F.array_join(F.transform(_c(values), shell_quote), " ")


def translate_prefix(value: C, old: str, new: str) -> Column:
    """A leading old replaced by new; a plain string prefix."""
    v = _c(value)
    return F.when(v.startswith(old), F.concat(F.lit(new), F.substr(v, F.lit(len(old) + 1)))).otherwise(v)


def hub_locator(locator: C) -> Column:
    """struct(kind, repo, revision): 'dataset:' marks datasets; the revision follows the last @, or is main."""
    v = _c(locator)
    dataset = v.startswith("dataset:")
    rest = F.regexp_replace(v, "^dataset:", "")
    revised = rest.contains("@")
    return F.struct(F.when(dataset, "dataset").otherwise("model").alias("kind"), F.when(revised, F.regexp_extract(rest, r"(?s)\A(.*)@[^@]*\z", 1)).otherwise(rest).alias("repo"), F.when(revised, F.substring_index(rest, "@", -1)).otherwise(F.lit("main")).alias("revision"))


def release_locator(locator: C) -> Column:
    """struct(repo, tag, pattern): repo[@tag][#pattern], by default latest and *; '#asset=' is accepted too."""
    v = _c(locator)
    at = F.instr(v, "#")
    head = F.when(at > 0, F.substr(v, F.lit(1), at - 1)).otherwise(v)
    pattern = F.when(at > 0, F.regexp_replace(F.substr(v, at + 1), "^asset=", "")).otherwise(F.lit("*"))
    tagged = head.contains("@")
    return F.struct(F.when(tagged, F.regexp_extract(head, r"(?s)\A(.*)@[^@]*\z", 1)).otherwise(head).alias("repo"), F.when(tagged, F.substring_index(head, "@", -1)).otherwise(F.lit("latest")).alias("tag"), pattern.alias("pattern"))


def dataset_version(major: C, minor: C) -> Column:
    """major.minor, minor 0 by default, latest without a major."""
    return F.when(_c(major).isNull(), F.lit("latest")).otherwise(F.concat_ws(".", _c(major).cast("string"), F.coalesce(_c(minor), F.lit(0)).cast("string")))


def fallback_name(locator: C, default: str) -> Column:
    """The last segment after # or /, if it has a dot."""
    last = F.regexp_extract(_c(locator), r"([^#/]*)\z", 1)
    return F.when(last.contains("."), last).otherwise(F.lit(default))


def lossy_text(data: C) -> Column:
    """Bytes as text; malformed ones become U+FFFD."""
    return F.make_valid_utf8(_c(data).cast("string"))


def attempt_status(finished_at: C, exit_code: C) -> Column:
    return F.when(_c(finished_at).isNull(), F.lit("running")).when(_c(exit_code) == 0, F.lit("success")).otherwise(F.lit("failed"))


def cost_micros(rate_per_hour: C, wall_millis: C) -> Column:
    """Micro-dollars, truncated; 0 without a rate. 128-bit products fit decimal(38)."""
    product = _c(rate_per_hour).cast("decimal(19,0)") * _c(wall_millis).cast("decimal(19,0)")
    hour = F.lit(3_600_000)  # milliseconds; the remainder goes first, as decimal division rounds
    return F.coalesce(((product - product % hour) / hour).cast("bigint"), F.lit(0))


def effect_receipt(action: C, attempt: C, exit_code: C, finished_at: C, stdout: C, stderr: C) -> Column:
    """JSON of an action that had effects but no outputs; keys in alphabetical order, nulls kept."""
    fields = [_c(action).alias("action"), _c(attempt).alias("attempt"), _c(exit_code).alias("exit_code"), _c(finished_at).alias("finished_at"), _c(stderr).alias("stderr"), _c(stdout).alias("stdout")]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def statement(subject_hex: C, predicate_type: str, predicate_json: C) -> Column:
    """An in-toto statement over one artifact; predicate_json is JSON text."""
    return F.concat(F.lit('{"_type":"https://in-toto.io/Statement/v1","subject":[{"name":"artifact","digest":{"sha256":"'), _c(subject_hex), F.lit('"}}],"predicateType":"'), F.lit(predicate_type), F.lit('","predicate":'), _c(predicate_json), F.lit("}"))


def capabilities(flags: dict[str, C]) -> Column:
    """The names of flags that are true, in the order given."""
    return F.array_compact(F.array(*[F.when(_c(v), F.lit(k)) for k, v in flags.items()]))
