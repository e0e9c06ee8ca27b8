"""Queries over accounts and the audit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts as op
from ..scale import with_position
from . import adapters as ad
from .registry import query, view


@query("a1_first_access", """
WITH u AS (SELECT *, verified AND provider IN ('google', '') AS proven, lower(email) AS e FROM v_users)
SELECT user_id, CASE WHEN proven AND (e = 'user7@mail.example.com' OR e LIKE '%@lab.example.edu') THEN 'active' ELSE 'pending' END AS status,
  CASE WHEN proven AND e = 'user7@mail.example.com' THEN 'admin' ELSE 'researcher' END AS role FROM u""")
def _(spark, sf):
    status, role = op.initial_access(F.col("email"), F.col("verified"), F.col("provider"), [" USER7@mail.example.com "], ["lab.example.edu"], ["google", ""])
    return ad.users(spark, sf).select("user_id", status.alias("status"), role.alias("role"))


@query("a2_user_list", """
SELECT u.user_id, u.email, u.status, a.name AS approved_by_name, a.email AS approved_by_email,
  row_number() OVER (ORDER BY u.status = 'pending' DESC, u.created_at DESC, u.user_id) AS place FROM v_users u LEFT JOIN v_users a ON a.user_id = u.approved_by""")
def _(spark, sf):
    users = op.user_list(ad.users(spark, sf)).withColumns({"__all": F.lit(0), "__settled": F.col("status") != "pending"})
    return with_position(users, ["__all"], ["__settled", F.desc("created_at"), "user_id"], "place").select(
        "user_id", "email", "status", "approved_by_name", "approved_by_email", "place")


@query("a2_account_counts", """
SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE role = 'admin' AND status = 'active') AS active_admins FROM v_users""")
def _(spark, sf):
    return op.account_counts(ad.users(spark, sf))


@query("a3_recent_audit", """
SELECT e.event_id AS audit_id, e.event_type AS action, u.name AS user_name, u.email AS user_email FROM (
  SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) e LEFT JOIN v_users u ON u.user_id = e.user_id""")
def _(spark, sf):
    log = ad.table(spark, sf, "events").select(F.col("event_id").alias("audit_id"), F.col("ts").alias("at"), "user_id", F.col("event_type").alias("action"))
    return op.recent_audit(log, ad.users(spark, sf)).select("audit_id", "action", "user_name", "user_email")


@query("a3_access_changes", """
SELECT e.event_id, CASE WHEN u.user_id IS NULL THEN 'No such account.' WHEN u.user_id = 7 AND (e.event_type = 'click' OR e.event_type = 'view')
  THEN 'This is the only active admin. Make someone else an admin first.' ELSE 'changed' END AS outcome
FROM events e LEFT JOIN v_users u ON u.user_id = e.user_id""")
def _(spark, sf):
    # All accounts, of which number 7 is left the only active admin.
    few = ad.users(spark, sf)
    few = few.withColumn("role", F.when((F.col("user_id") != 7) & (F.col("role") == "admin"), "viewer").otherwise(F.col("role")))
    asked = ad.table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_type") == "click", "disabled").alias("new_status"),
                                                 F.when(F.col("event_type") == "view", "viewer").when(F.col("event_type") == "error", "admin").alias("new_role"))
    return op.access_changes(asked, few).select("event_id", "outcome")
