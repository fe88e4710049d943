"""Source trust, file safety and ingest policy (GTE1-GTE16)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions import text as T


def trusted_sources(*lists: DataFrame) -> DataFrame:
    """GTE1: union of configured source lists, lower-cased and distinct. Column ``source``."""
    out = None
    for df in lists:
        one = df.select(F.lower(T.strip(F.col(df.columns[0]))).alias("source")).filter("source <> ''")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def trust(mails: DataFrame, sources: DataFrame, domains: DataFrame) -> DataFrame:
    """GTE2: trust decision and reason.

    ``mails(sender, client, mailbox)``. The lists are joined without a broadcast hint:
    Spark broadcasts them while their measured size is under its threshold and
    shuffles them when somebody configures a large one.
    """
    df = (mails.withColumn("_s", T.mail_address(F.coalesce("sender", F.lit("")))).withColumn("_c", T.mail_address(F.coalesce("client", F.lit(""))))
          .withColumn("_m", F.lower(T.strip(F.coalesce("mailbox", F.lit(""))))))
    # Rows without a value get a key of their own that matches nothing, so they spread over all tasks.
    own = F.concat(F.lit("\u0001"), F.xxhash64(*mails.columns).cast("string"))

    def looked_up(df, value, names, column, flag):
        listed = names.select(F.col(column).alias("_k"), F.lit(True).alias(flag))
        return df.withColumn("_k", F.when(F.col(value) == "", own).otherwise(F.col(value))).join(listed, "_k", "left").drop("_k")

    for c in ("_s", "_c", "_m"):
        df = looked_up(df, c, sources, "source", c + "_ok")
    for c in ("_s", "_c"):
        df = df.withColumn(c + "d", F.when(F.contains(F.col(c), F.lit("@")), F.substring_index(c, "@", -1)).otherwise(F.lit("")))
        df = looked_up(df, c + "d", domains, "domain", c + "d_ok")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    quoted = lambda a, b, c: F.concat(F.lit(a), b, F.lit(c))
    who = F.coalesce(F.nullif("_s", F.lit("")), F.nullif("_c", F.lit("")), F.lit("unknown"))
    inner = (F.col("_s") == "") & (F.col("_m") != "") & yes("_m_ok")
    reason = (
        F.when(yes("_s_ok"), quoted("Sender '", F.col("_s"), "' is verified"))
        .when(yes("_c_ok"), quoted("Original client '", F.col("_c"), "' is verified"))
        .when(yes("_sd_ok"), quoted("Domain '@", F.col("_sd"), "' is authorized"))
        .when(yes("_cd_ok"), quoted("Domain '@", F.col("_cd"), "' is authorized"))
        .when(inner, quoted("Internal channel '", F.col("_m"), "' is verified"))
        .otherwise(quoted("Sender '", who, "' is not registered"))
    )
    ok = yes("_s_ok") | yes("_c_ok") | yes("_sd_ok") | yes("_cd_ok") | inner
    df = df.withColumn("trusted", ok).withColumn("trust_reason", reason)
    return df.select(*mails.columns, "trusted", "trust_reason")


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(name, r"([^/]*)$", 1), r"^.+\.([^.]+)$", 1))


def header_mismatch(suffix: Column, head: Column) -> Column:
    """GTE4: what a suffix claims when the leading bytes (hex) do not back it, else null."""
    starts = lambda magics: head.rlike("^(?:" + "|".join(magics) + ")")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for suffixes, magics, label in rules.CONTAINER_HEADERS:
        out = out.when(suffix.isin(suffixes), F.when(~starts(magics), label))
    return (
        out.when(suffix == "tar", F.when(F.substring(head, 257 * 2 + 1, 10) != "7573746172", "tar archive"))
        .when(suffix == "dxf", F.when(~head.rlike("^(?:..){0,1023}(?:53454354494F4E|4175746F4341442042696E61727920445846)"), "DXF drawing"))
        .when(suffix.isin("heic", "heif", "hif", "avif"), F.when(F.substring(head, 9, 8) != "66747970", "HEIF image"))
        .when(suffix == "eml", F.when(~head.rlike("^(?:(?:..)*?0A)?(?:[46][1-9A-F]|[57][0-9A])(?:2D|3[0-9]|[46][1-9A-F]|[57][0-9A]){1,40}3A"), "MIME message"))
    )


def file_safety(name: Column, size: Column, head: Column) -> Column:
    """GTE3: ``SAFE`` or the reason a file is refused. ``head`` is hex of the first 4 KiB."""
    clean = T.strip(name)
    parts = F.split(F.lower(clean), r"\.")
    label = F.get(parts, F.size(parts) - 2)
    suffix = suffix_of(clean)
    spoof = header_mismatch(suffix, head)
    say = lambda a: F.concat(F.lit(a + ": '"), clean, F.lit("'"))
    return (
        F.when(name.isNull() | (name == ""), "Empty filename")
        .when(size > rules.MAX_ATTACHMENT_BYTES, "Attachment exceeds maximum allowed size")
        .when((F.size(parts) >= 3) & label.isin(rules.EXECUTABLE_LABELS), say("Double-extension spoofing detected"))
        .when(suffix.isin(rules.DANGEROUS_EXTENSIONS), F.concat(F.lit("Executable or script extension blocked: '."), suffix, F.lit("'")))
        .when(head.rlike("^(?:4D5A|7F454C46|CAFEBABE)"), say("Dangerous executable header"))
        .when((suffix == "pdf") & ~head.rlike("^(?:..){0,1019}255044462D"), say("Spoofed or corrupted PDF header"))
        .when(suffix.isin("docx", "xlsx") & ~F.startswith(head, F.lit("504B0304")), say("Spoofed or corrupted Office OpenXML container"))
        .when(spoof.isNotNull(), F.concat(F.lit("Spoofed or corrupted "), spoof, F.lit(" header")))
        .otherwise("SAFE")
    )


def encoded_too_large(encoded: Column, max_bytes: int) -> Column:
    """GTE5: decoded size from the encoded length alone."""
    return F.floor(F.length(encoded) / 4) * 3 > max_bytes


def member_name(name: Column) -> Column:
    """GTE7: base name of a container member; null for directories, hidden and escaping names."""
    n = F.replace(name, F.lit("\\"), F.lit("/"))
    base = F.regexp_extract(n, r"([^/]+)$", 1)
    bad = n.rlike(r"(?:^|/)\.\.(?:/|$)|^/|/$") | (base == "") | F.startswith(base, F.lit("."))
    return F.when(~bad, base)


def admit_members(mails: DataFrame, max_members: int, max_member_bytes: int, max_bytes: int, members: str = "members") -> DataFrame:
    """GTE6: which members of a mail's containers are taken, in order, and why the others are not.

    ``members`` is the mail's own manifest ``ARRAY<STRUCT<name,size,safe>>`` in a total order:
    by position, and for members of one position by name, size and safety, so that tied
    rows give one result. A refused member spends nothing, so this is an ordered fold and
    not a running sum.
    """
    zero = F.struct(F.lit(max_members).alias("n"), F.lit(max_bytes).cast("bigint").alias("b"), F.array().cast("array<string>").alias("taken"),
                    F.array().cast("array<struct<name:string,reason:string>>").alias("refused"))

    def step(a, m):
        base = member_name(m["name"])
        yes = lambda c: F.coalesce(c, F.lit(False))
        reason = (F.when(base.isNull(), "name").when(~yes(m["safe"]), "unsafe").when(~yes(m["size"] <= max_member_bytes), "size").when(F.array_contains(a["taken"], base), "repeated")
                  .when(a["n"] <= 0, "number").when(~yes(m["size"] <= a["b"]), "total"))
        took = F.struct((a["n"] - 1).alias("n"), (a["b"] - m["size"]).alias("b"), F.concat(a["taken"], F.array(base)).alias("taken"), a["refused"].alias("refused"))
        left = F.struct(a["n"].alias("n"), a["b"].alias("b"), a["taken"].alias("taken"), F.concat(a["refused"], F.array(F.struct(m["name"].alias("name"), reason.alias("reason")))).alias("refused"))
        return F.when(reason.isNull(), took).otherwise(left)

    done = mails.withColumn("_admitted", F.aggregate(members, zero, step, lambda a: F.struct(a["taken"].alias("taken"), a["refused"].alias("refused"))))
    return done.select("*", "_admitted.taken", "_admitted.refused").drop("_admitted")


def walked_members(members: DataFrame, levels: int) -> DataFrame:
    """GTE6: adds ``path`` (positions from the outermost container to the member) and ``layer`` to nested members.

    ``members(mail, pos, parent, ...)`` with one row per (mail, pos); ``parent`` is the position
    of the container that holds the member, null for the mail's own. Only as many layers
    are walked as may be opened and one more, each by an equi-join on mail and position,
    so neither the plan nor the work depends on how deep a manifest nests. Members
    below that have the path of their nearest ancestors and a layer beyond ``levels``; so has one
    whose container the manifest lacks, or that lies in a cycle.
    """
    held = members.select(F.col("mail").alias("_mail"), F.col("pos").alias("_pos"), F.col("parent").alias("_up_next"), F.lit(True).alias("_there"))
    out = members.withColumn("path", F.array("pos")).withColumn("layer", F.lit(1)).withColumn("_up", F.col("parent"))
    for _ in range(levels):
        out = out.join(held, (F.col("mail") == F.col("_mail")) & (F.col("_up") == F.col("_pos")), "left")
        climbed = F.col("_up").isNotNull()
        out = out.withColumns({
            "path": F.when(climbed, F.concat(F.array("_up"), F.col("path"))).otherwise(F.col("path")),
            "layer": F.when(climbed, F.col("layer") + 1).otherwise(F.col("layer")),
            "_up": F.when(F.col("_there"), F.col("_up_next")).otherwise(F.col("_up"))}).drop("_mail", "_pos", "_up_next", "_there")
    return out.withColumn("layer", F.when(F.col("_up").isNotNull(), F.lit(levels + 1)).otherwise(F.col("layer"))).drop("_up")


def admit_nested(walked: DataFrame, levels: int, max_members: int, max_member_bytes: int, max_bytes: int) -> DataFrame:
    """GTE6 for containers in containers: ``mail, taken, refused`` per mail, from :func:`walked_members`.

    Members come in pre-order, so a container's own come right behind it, and all layers
    spend one budget. A member is refused for its depth, or because its container was refused,
    then for the reasons of a flat manifest; a name counts as repeated inside its own
    container only. ``taken`` holds (path, name), ``refused`` (path, reason). A manifest
    belongs to one mail and is folded in one row.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    fields = ["path", "name", "size", "safe", "parent", "pos", "layer", "container"]
    manifest = walked.groupBy("mail").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_m"))
    zero = F.struct(F.lit(max_members).alias("n"), F.lit(max_bytes).cast("bigint").alias("b"), F.array().cast("array<struct<path:array<int>,name:string>>").alias("taken"),
                    F.array().cast("array<struct<up:int,name:string>>").alias("names"), F.array().cast("array<int>").alias("open"),
                    F.array().cast("array<struct<path:array<int>,reason:string>>").alias("refused"))

    def step(a, m):
        base = member_name(m["name"])
        named = F.struct(m["parent"].alias("up"), base.alias("name"))
        reason = (F.when(m["layer"] > levels, "depth").when(m["parent"].isNotNull() & ~yes(F.array_contains(a["open"], m["parent"])), "container").when(base.isNull(), "name")
                  .when(~yes(m["safe"]), "unsafe").when(~yes(m["size"] <= max_member_bytes), "size").when(yes(F.array_contains(a["names"], named)), "repeated")
                  .when(a["n"] <= 0, "number").when(~yes(m["size"] <= a["b"]), "total"))
        took = F.struct((a["n"] - 1).alias("n"), (a["b"] - m["size"]).alias("b"), F.concat(a["taken"], F.array(F.struct(m["path"].alias("path"), base.alias("name")))).alias("taken"),
                        F.concat(a["names"], F.array(named)).alias("names"), F.when(yes(m["container"]), F.concat(a["open"], F.array(m["pos"]))).otherwise(a["open"]).alias("open"), a["refused"].alias("refused"))
        left = F.struct(a["n"].alias("n"), a["b"].alias("b"), a["taken"].alias("taken"), a["names"].alias("names"), a["open"].alias("open"),
                        F.concat(a["refused"], F.array(F.struct(m["path"].alias("path"), reason.alias("reason")))).alias("refused"))
        return F.when(reason.isNull(), took).otherwise(left)

    return manifest.withColumn("_a", F.aggregate("_m", zero, step)).select("mail", "_a.taken", "_a.refused")


def staging(df: DataFrame) -> DataFrame:
    """GTE8: staging status, security status and category of an inbound mail.

    Needs trusted, trust_reason, unsafe (boolean), category.
    """
    return (
        df.withColumn("security_status", F.when(~F.col("trusted") | F.col("unsafe"), "BLOCKED").otherwise("CLEAN"))
        .withColumn("stage_status", F.when(~F.col("trusted") | F.col("unsafe") | (F.col("category") == "SPAM"), "QUARANTINED").otherwise("APPROVED"))
        .withColumn("category", F.when(~F.col("trusted"), "UNTRUSTED_SOURCE").otherwise(F.col("category")))
    )


def effective_mode(df: DataFrame, policies: DataFrame, default: str, out: str = "mode") -> DataFrame:
    """GTE9: a mailbox's own mode, else the global one. ``policies(mailbox, mode)``."""
    p = policies.select(F.col("mailbox").alias("source_mailbox"), F.col("mode").alias("_mode"))
    return df.join(p, "source_mailbox", "left").withColumn(out, F.coalesce("_mode", F.lit(default))).drop("_mode")


def effective_disposition(df: DataFrame, policies: DataFrame, default: str) -> DataFrame:
    """GTE10: item override, mailbox policy, global default; compared in lower case."""
    item = F.lower(F.nullif(F.upper("disposition_override"), F.lit("INHERIT")))
    return effective_mode(df, policies, default, "_m").withColumn("disposition", F.coalesce(item, "_m")).drop("_m")


def valid_policies(policies: DataFrame) -> DataFrame:
    """GTE13: only auto and manual are kept. ``policies(scope, mailbox, mode)``."""
    return policies.filter(F.col("mode").isin("auto", "manual"))


def bulk_approve(staged: DataFrame, mailbox: str | None = None, quarantined: bool = False) -> DataFrame:
    """GTE11: what a bulk approval does to each eligible row; blocked rows are never approved."""
    ok = F.col("status").isin(["STAGED"] + (["QUARANTINED"] if quarantined else []))
    if mailbox:
        ok = ok & (F.col("source_mailbox") == mailbox)
    return staged.filter(ok).withColumn("outcome", F.when(F.col("security_status") == "BLOCKED", "skipped_blocked").otherwise("approved"))


def reapply_policy(staged: DataFrame, policies: DataFrame, default: str) -> DataFrame:
    """GTE12: held, clean mails whose mailbox is on auto now."""
    held = staged.filter("status = 'STAGED' AND security_status <> 'BLOCKED'")
    return effective_mode(held, policies, default).filter("mode = 'auto'")


def latest_assignments(mails: DataFrame, changes: DataFrame) -> DataFrame:
    """GTE14: latest assignment per mail (default HOLD); an empty note keeps the old one."""
    at = F.struct("updated_at", "change_id")
    a = changes.groupBy("email_id").agg(F.max_by("assignment", at).alias("assignment"),
                                        F.max_by("note", F.when(F.col("note").isNotNull(), at)).alias("note"))
    return mails.select("email_id").join(a, "email_id", "left").withColumn("assignment", F.coalesce("assignment", F.lit("HOLD")))


def run_eligibility(requested: DataFrame, owned: DataFrame, assignments: DataFrame, include_ignored: bool = False) -> DataFrame:
    """GTE15: which requested mails run, and why the others do not."""
    df = (requested.select("email_id").distinct()
          .join(owned.select("email_id").distinct().withColumn("_own", F.lit(True)), "email_id", "left")
          .join(assignments.select("email_id", "assignment"), "email_id", "left"))
    skip = F.when(F.col("_own").isNull(), "not in this workspace")
    if not include_ignored:
        skip = skip.when(F.col("assignment") == "IGNORE", "assigned IGNORE")
    return df.select("email_id", skip.isNull().alias("runs"), skip.alias("reason"))


def staging_status(security: Column, category: Column, mode: Column) -> Column:
    """GTE16."""
    return (F.when((security == "BLOCKED") | (category == "SPAM"), "QUARANTINED").when(mode == "auto", "AUTO_INGESTED").otherwise("STAGED"))


