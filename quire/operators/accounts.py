"""Invites, accounts, tokens, access and error reports: validation, state steps, views."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import email, invite_hash, redact_secrets
from quire.operators.jobs import invite_expired
from quire.sources.scratch import settled

# Access states; limits of error reports and stores.
ACCESS = ("none", "pending", "allowed", "denied", "byok")
KIND_CHARS, MESSAGE_CHARS, STACK_CHARS = 64, 500, 4000
MOST_LINKS, USED_DAYS, UNUSED_DAYS = 500, 2, 1
MOST_TOKEN = 200
PROVIDERS = ("google", "kakao", "email")
#: Anchored grammars of identifiers.
GRAMMAR = {
    "cache": r"^[A-Za-z0-9_\-]{1,64}$",
    "job": r"^[a-f0-9]{8,64}$",
    "upload": r"^upl_[a-f0-9]{12}$",
    "sentence": r"^sent_\d{1,8}$",
    "uid": r"^[A-Za-z0-9_\-:.]{1,128}$",
}


def valid_id(kind: str, value: Column) -> Column:
    return F.coalesce(value.rlike(GRAMMAR[kind]) & ~F.contains(value, F.lit("..")), F.lit(False))


def safe_cache_id(value: Column) -> Column:
    """The id, or blank where it is none."""
    return F.when(valid_id("cache", value), value).otherwise("")


def error_events(reports: DataFrame) -> DataFrame:
    """Reports (ts, kind, message, stack, uid, cache_id, ...) that say something, secrets removed, ids checked."""
    cut = lambda c, n: F.substring(F.trim(F.coalesce(F.col(c), F.lit(""))), 1, n)
    kind, message = cut("kind", KIND_CHARS), F.trim(F.coalesce("message", F.lit("")))
    clean = reports.where((kind != "") & (message != ""))
    out = {"kind": kind, "message": redact_secrets(message, MESSAGE_CHARS), "stack": redact_secrets(F.col("stack"), STACK_CHARS), "cache_id": safe_cache_id(F.col("cache_id"))}
    named = clean.select(*[out.get(c, F.col(c)).alias(c) for c in clean.columns])
    return named.withColumn("id", F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("ts", "uid", "kind", "message")]).cast("binary"), 256), 1, 16))


def merge_accounts(users: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users (replica, uid, ...) with the first of each; links (replica, provider_key, uid) whose user exists, first of each."""
    first = lambda df, key: df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("replica"))).where("_k = 1").drop("_k")
    people = first(users, "uid")
    return people, first(links, "provider_key").join(people.select("uid"), "uid", "left_semi")


def merge_tokens(rows: DataFrame) -> DataFrame:
    """Sign-in tokens (replica, hash, used, exp): a used one wins, else the one that lasts longer, later replica at ties."""
    order = [F.col("used").desc(), F.col("exp").desc(), F.col("replica").desc()]
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("hash").orderBy(*order))).where("_k = 1").drop("_k")


def prune_tokens(rows: DataFrame, now: Column, keep: int = MOST_LINKS) -> DataFrame:
    """Tokens that are not long gone, the newest `keep`."""
    age = now - F.col("exp")
    limit = F.when(F.col("used"), USED_DAYS * 86_400).otherwise(UNUSED_DAYS * 86_400)
    return rows.where(age <= limit).orderBy(F.desc("exp"), "hash").limit(keep)


def redeem_outcomes(attempts: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Attempts (keys, at, tie, uid, expires, revoked) in order, each with its code.

    The first good attempt redeems an invite; the same user may repeat it, others find it used.
    """
    columns = [*keys, at, tie, "uid", "expires", "revoked"]
    kinds = ", ".join(f"`{c}` {attempts.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, owner = None, None
        for pdf in batches:
            codes = []
            for row in zip(*[pdf[c] for c in [*keys, at, "uid", "expires", "revoked"]]):
                if row[: len(keys)] != key:
                    key, owner = row[: len(keys)], None
                now, uid, expires, revoked = row[len(keys) :]
                if owner is not None:
                    codes.append("ok_again" if uid == owner else "used")
                elif revoked:
                    codes.append("revoked")
                elif now > expires:
                    codes.append("expired")
                else:
                    owner = uid
                    codes.append("ok")
            yield pdf.assign(code=codes)

    return attempts.select(columns).repartition(*keys).sortWithinPartitions(*keys, at, tie).mapInPandas(run, kinds + ", code string")


def redeem_tokens(attempts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Attempts (token, at, tie) to use sign-in tokens (hash, email, exp, used), each with its code and the address it gave.

    Blank, overlong and unknown tokens are bad_token, and so is one without a valid address, which stays unused.
    The first other attempt at a token decides: expired after its time, else ok; all later ones find it used.
    Of repeated hashes a used record counts first, then the one that lasts longest.
    """
    bare = F.trim(F.coalesce("token", F.lit("")))
    kept = tokens.groupBy("hash").agg(F.max_by(F.struct("email", F.coalesce("exp", F.lit(0)).alias("exp"), F.coalesce("used", F.lit(False)).alias("used")), F.struct(F.coalesce("used", F.lit(False)).alias("used"), F.coalesce("exp", F.lit(0)).alias("exp"), F.coalesce("email", F.lit("")).alias("email"))).alias("t"))
    known = attempts.select("token", "at", "tie", F.when((bare != "") & (F.length(bare) <= MOST_TOKEN), F.sha2(bare, 256)).alias("hash")).join(kept, "hash", "left")
    address = email(F.col("t.email"))
    # A token with no address never changes, so its attempts are bad as long as its time has not come.
    open_ = F.col("t").isNotNull() & ~F.col("t.used")
    late, lost = F.col("t.exp") < F.col("at"), address.isNull()
    spends = open_ & (late | ~lost)
    before = Window.partitionBy(F.coalesce("hash", F.concat_ws("-", "at", "tie"))).orderBy("at", "tie").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.max(spends).over(before), F.lit(False))
    code = F.when(F.col("t").isNull(), "bad_token").when(F.col("t.used") | spent, "used").when(late, "expired").when(lost, "bad_token").otherwise("ok")
    rows = known.withColumn("code", code)
    return rows.select("token", "at", "tie", "code", F.when(F.col("code") == "ok", address).alias("email"))


#: A command on linked accounts and its outcome.
OUTCOME = "seq long, code string, account string"


def account_step(users: dict[str, dict[str, str]], owners: dict[str, str], op: str, uid: str, provider: str, subject: str, fresh: str) -> tuple[str, str | None]:
    """Carry out one command on users (uid -> provider -> subject) and owners (provider:subject -> uid).

    resolve: the owner of a way to sign in, or a new account for it, under the wanted uid if that is free.
    link: one more way, unless another account has it. unlink: one way less, never the last.
    """
    key = f"{provider}:{subject}"
    if provider not in PROVIDERS or (op != "unlink" and not subject) or (op != "resolve" and not uid):
        return "invalid", None
    if op == "resolve":
        if owners.get(key) in users:
            return "ok", owners[key]
        new = uid or (subject if provider == "google" else fresh)
        if new in users:
            new = fresh
        users.setdefault(new, {})[provider] = subject
        owners[key] = new
        return "created", new
    if uid not in users:
        return "user_missing", None
    if op == "link":
        if owners.get(key, uid) != uid:
            return "conflict", None
        users[uid][provider] = subject
        owners[key] = uid
        return "ok", uid
    if provider not in users[uid]:
        return "not_linked", None
    if len(users[uid]) <= 1:
        return "last_provider", None
    key = f"{provider}:{users[uid].pop(provider)}"
    if owners.get(key) == uid:
        del owners[key]
    return "ok", uid


def command_groups(commands: DataFrame, rounds: int = 40) -> DataFrame:
    """(seq, grp): commands that touch a common uid or way to sign in, at any remove, share a group.

    Keys and commands are a graph; every round a command takes the smallest group of its keys, and a key that of
    its commands, and the state is written. A round in which nothing moves ends it.
    """
    way = F.concat_ws(":", "provider", F.col("subject"))
    names = F.array(F.concat(F.lit("u:"), F.when(F.col("uid") != "", F.col("uid"))), F.concat(F.lit("u:"), F.when(F.col("op") == "resolve", F.col("fresh"))), F.concat(F.lit("u:"), F.when((F.col("op") == "resolve") & (F.col("provider") == "google"), F.col("subject"))), F.concat(F.lit("w:"), F.when(F.col("op") != "unlink", way)))
    edges = settled(commands.select("seq", F.explode(F.array_distinct(F.array_compact(names))).alias("name")), "edges")
    groups = settled(commands.select("seq", F.col("seq").alias("grp")), "groups")
    for _ in range(rounds):
        keys = edges.join(groups, "seq").groupBy("name").agg(F.min("grp").alias("low"))
        lower = edges.join(keys, "name").groupBy("seq").agg(F.min("low").alias("low"))
        moved = settled(groups.join(lower, "seq", "left").select("seq", "grp", F.least("grp", F.coalesce("low", "grp")).alias("low")), "groups")
        # Groups themselves move on: a group whose first command has joined a lower one follows it.
        heads = moved.select(F.col("seq").alias("low"), F.col("low").alias("next"))
        groups = settled(moved.join(heads, "low", "left").select("seq", "grp", F.least("low", F.coalesce("next", "low")).alias("low")), "groups")
        done = groups.where("low <> grp").isEmpty()
        groups = groups.select("seq", F.col("low").alias("grp"))
        if done:
            return groups
    raise RuntimeError("command groups did not settle")


def linked_accounts(commands: DataFrame) -> DataFrame:
    """Commands (seq, op, uid, provider, subject, fresh) in order of seq, each with its code and account.

    Two commands that share no account and no way to sign in, at any remove, cannot affect each other: commands
    are dealt by connected groups and replayed inside them, holding the accounts of one group at a time.
    """
    clean = commands.select("seq", *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("op", "uid", "fresh")], F.lower(F.trim(F.coalesce("provider", F.lit("")))).alias("provider"), F.trim(F.coalesce("subject", F.lit(""))).alias("subject"))
    clean = settled(clean.withColumn("subject", F.when(F.col("provider") == "email", F.lower("subject")).otherwise(F.col("subject"))), "commands")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, users, owners = None, {}, {}
        for pdf in batches:
            out = []
            for seq, grp, *rest in zip(*[pdf[c] for c in ("seq", "grp", "op", "uid", "provider", "subject", "fresh")]):
                if grp != group:
                    group, users, owners = grp, {}, {}
                out.append((seq, *account_step(users, owners, *rest)))
            yield pd.DataFrame(out, columns=["seq", "code", "account"])

    return clean.join(command_groups(clean), "seq").repartition("grp").sortWithinPartitions("grp", "seq").mapInPandas(run, OUTCOME)


def access_status(raw: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(low.isin(*ACCESS), low).otherwise("none")


def may_use_paid(gate_on: Column, is_admin: Column, status: Column) -> Column:
    return ~gate_on | is_admin | access_status(status).isin("allowed", "byok")


def is_admin(address: Column, admins: Column) -> Column:
    """Whether an address is in a comma-separated list."""
    listed = F.filter(F.transform(F.split(F.coalesce(admins, F.lit("")), ","), lambda e: F.lower(F.trim(e))), lambda e: e != "")
    return F.coalesce(F.array_contains(listed, F.lower(F.trim(address))), F.lit(False))


def pending(accounts: DataFrame) -> DataFrame:
    """Accounts that wait for a decision, oldest invitation first."""
    return accounts.where(access_status(F.col("status")) == "pending").orderBy("invited_at", "uid")


def open_invites(invites: DataFrame, now: Column, ttl: int) -> DataFrame:
    """Open invites, expired ones left out as they are read."""
    live = ~invite_expired(F.col("expires_at"), F.col("created_at"), now, ttl)
    return invites.where((F.col("status") == "open") & live).select("hash", "created_at", F.coalesce("expires_at", F.col("created_at") + ttl).alias("expires_at"))


INVITE = "hash string, status string, created_at long, expires_at long, created_by string, note string"


def mint_invites(store: DataFrame, requests: DataFrame, ttl: int, keep: int = 2000) -> tuple[DataFrame, DataFrame]:
    """The store of invites with new ones behind the old, its last `keep`, and the codes of the requests.

    requests: (code, at, admin_uid, admin_email, note), the code drawn outside. Only its digest is stored. A blank
    code is mint_failed; one whose digest is in the store, or was asked for before, is mint_collision.
    """
    by = F.coalesce(F.nullif(F.trim(F.coalesce("admin_uid", F.lit(""))), F.lit("")), F.substring(F.coalesce("admin_email", F.lit("")), 1, 120))
    asked = requests.select("code", "at", invite_hash(F.col("code")).alias("hash"), by.alias("created_by"), F.substring(F.coalesce("note", F.lit("")), 1, 200).alias("note"))
    # A blank code's requests are told apart, so that they do not meet in one task.
    turn = F.row_number().over(Window.partitionBy(F.when(F.col("hash") == "", F.concat_ws("-", "at", "created_by", "note")).otherwise(F.col("hash"))).orderBy("at", "created_by", "note"))
    known = store.select("hash", F.lit(True).alias("there")).distinct()
    coded = asked.withColumn("turn", turn).join(known, "hash", "left")
    coded = coded.withColumn("outcome", F.when(F.col("hash") == "", "mint_failed").when(F.col("there") | (F.col("turn") > 1), "mint_collision").otherwise("ok"))
    until = F.when(F.lit(ttl) > 0, F.col("at") + ttl)
    new = coded.where("outcome = 'ok'").select("hash", F.lit("open").alias("status"), F.col("at").alias("created_at"), until.alias("expires_at"), "created_by", "note")
    both = store.select("hash", "status", "created_at", "expires_at", "created_by", "note", F.lit(0).alias("late")).unionByName(new.withColumn("late", F.lit(1)))
    kept = both.orderBy(F.desc("late"), F.desc("created_at"), F.desc("hash")).limit(keep).drop("late")
    return kept, coded.select("code", "at", "outcome")


def progress_row(progress: DataFrame, wanted: DataFrame, doc: str) -> DataFrame:
    """The progress of each document under its strongest alias: wanted has (doc, alias_key, priority)."""
    found = wanted.join(progress, "alias_key")
    return found.groupBy(doc).agg(F.min_by(F.struct("sentence_index", "figure_index", "at"), F.struct("priority", "alias_key")).alias("p")).select(doc, "p.*")


def progress_reason(sentence: Column, figure: Column, sentences: Column, figures: Column) -> Column:
    """Why a stored position cannot be restored, or ok."""
    return (
        F.when(sentence.isNull() | figure.isNull(), "missing")
        .when((sentences <= 0) | (sentence < 0) | (sentence >= sentences), "sentence_range")
        .when((figure < 0) | ((figures > 0) & (figure >= figures)) | ((figures <= 0) & (figure > 0)), "figure_range")
        .otherwise("ok")
    )


def patch(old: Column, new: Column) -> Column:
    """A value that changes only when a new one is given."""
    return F.coalesce(new, old)
