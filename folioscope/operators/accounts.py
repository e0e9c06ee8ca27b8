"""Accounts and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def initial_access(email: Column, verified: Column, provider: Column, admins: list[str], domains: list[str],
                   trusted: list[str]) -> tuple[Column, Column]:
    """(status, role) of someone signing in for the first time: only a proven address of an
    admin or of an approved domain is let in at once."""
    e = F.lower(F.trim(email))
    proven = (e != "") & verified & provider.isin(*trusted)
    admin = proven & e.isin(*[a.strip().lower() for a in admins])
    member = proven & F.substring_index(e, "@", -1).isin(*[d.strip().lower() for d in domains])
    return (F.when(admin | member, "active").otherwise("pending"), F.when(admin, "admin").otherwise("researcher"))


def user_list(users: DataFrame) -> DataFrame:
    """Users with who approved them. The order is pending first, then newest."""
    by = users.select(F.col("user_id").alias("approved_by"), F.col("name").alias("approved_by_name"), F.col("email").alias("approved_by_email"))
    return users.join(by, "approved_by", "left")


def account_counts(users: DataFrame) -> DataFrame:
    return users.agg(F.count_if(F.col("status") == "pending").alias("pending"),
                     F.count_if((F.col("role") == "admin") & (F.col("status") == "active")).alias("active_admins"))


def recent_audit(log: DataFrame, users: DataFrame, limit: int = 50) -> DataFrame:
    who = users.select("user_id", F.col("name").alias("user_name"), F.col("email").alias("user_email"))
    return log.orderBy(F.desc("at"), F.desc("audit_id")).limit(limit).join(who, "user_id", "left")


def access_changes(changes: DataFrame, users: DataFrame) -> DataFrame:
    """Each asked change of access on its own (`user_id`, `new_status`, `new_role`): refused
    when it would take the only active admin away."""
    admins = users.agg(F.count_if((F.col("role") == "admin") & (F.col("status") == "active"))).scalar()      # counted when the changes are read
    j = changes.join(users.select("user_id", "status", "role"), "user_id", "left")
    loses = (F.col("role") == "admin") & (F.col("status") == "active") & (
        (F.coalesce("new_role", F.lit("admin")) != "admin") | (F.coalesce("new_status", F.lit("active")) != "active"))
    return j.withColumn("outcome", F.when(F.col("status").isNull(), "No such account.").when(
        loses & (admins <= 1), "This is the only active admin. Make someone else an admin first.").otherwise("changed"))
