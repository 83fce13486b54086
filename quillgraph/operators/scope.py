"""Row-level policy: per agent, rules of path prefixes that allow or forbid reading and writing."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A prefix and what it says; None says nothing."""

    prefix: str
    read: bool | None = None
    write: bool | None = None


class PolicyError(ValueError):
    """A policy that can't be compiled, or an identity that it doesn't know."""


def normalized(prefix: str | None) -> str:
    bare = re.sub(r"^/+|/+$", "", prefix or "")
    return f"{bare}/" if bare else ""


def compiled(policy: dict | None) -> dict[str, list[Rule]] | None:
    """Rules by agent, the longest prefix first. None means that there is no policy."""
    if policy is None:
        return None
    out: dict[str, list[Rule]] = {}
    for agent, rules in policy.items():
        if not isinstance(rules, list):
            raise PolicyError(f"scopes of {agent!r} must be a list")
        found: list[Rule] = []
        for rule in rules:
            if not isinstance(rule, dict):
                raise PolicyError(f"a rule of {agent!r} must be an object")
            if not isinstance(rule.get("prefix", ""), str):
                raise PolicyError(f"a prefix of {agent!r} must be a string")
            for permission in ("read", "write"):
                if rule.get(permission) is not None and not isinstance(rule[permission], bool):
                    raise PolicyError(f"{permission} of {agent!r} must be true or false")
            prefix = normalized(rule.get("prefix"))
            if any(part in ("", ".", "..") for part in prefix.split("/")[:-1]):
                raise PolicyError(f"prefix {rule['prefix']!r} of {agent!r} isn't canonical")
            found.append(Rule(prefix, rule.get("read"), rule.get("write")))
        for permission in ("read", "write"):
            said = [r.prefix for r in found if getattr(r, permission) is not None]
            if len(said) != len(set(said)):
                raise PolicyError(f"{agent!r} has two rules for {permission} of one prefix")
        found.sort(key=lambda r: (-len(r.prefix), r.prefix))
        for rule in found:
            if may(found, "write", rule.prefix) and not may(found, "read", rule.prefix):
                raise PolicyError(f"{agent!r} could write but not read under {rule.prefix!r}")
        out[agent] = found
    return out


def may(rules: list[Rule] | None, permission: str, path: str) -> bool:
    """What the longest prefix that says something allows; without one, nothing. None is no policy: everything."""
    if rules is None:
        return True
    for rule in rules:
        if getattr(rule, permission) is not None and path.startswith(rule.prefix):
            return getattr(rule, permission)
    return False


def rules_for(policy: dict[str, list[Rule]] | None, agent: str | None) -> list[Rule] | None:
    """The rules of an agent; with a policy, an unknown or missing agent is refused."""
    if policy is None:
        return None
    if agent is None or not agent.strip():
        raise PolicyError("a policy is in force: say who asks")
    if agent not in policy:
        raise PolicyError(f"unknown agent {agent!r}")
    return policy[agent]


def readable(rules: list[Rule] | None, path: Column) -> Column:
    """The read rules as a predicate. Pure allows become an OR of prefixes, which parquet scans can use."""
    if rules is None:
        return F.lit(True)
    said = [r for r in rules if r.read is not None]
    if all(r.read for r in said):
        allowed = F.lit(False)
        for rule in said:
            allowed = allowed | path.startswith(rule.prefix)
        return allowed
    decision = F.lit(False)
    for rule in reversed(said):
        decision = F.when(path.startswith(rule.prefix), F.lit(rule.read)).otherwise(decision)
    return decision


def decisions(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(agent, path, allowed) of all agents of rules (agent, prefix, allow) over paths, by the longest prefix.

    Each path is expanded to its own prefixes, so the rules are an equi-join and not a comparison with all.
    """
    parts = F.split("path", "/")
    n = F.size(parts)
    prefixes = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))
    expanded = paths.select("path", F.explode(prefixes).alias("prefix"))
    best = expanded.join(rules, "prefix").groupBy("agent", "path").agg(F.max_by("allow", F.length("prefix")).alias("allowed"))
    agents = rules.select("agent").distinct()
    return paths.select("path").distinct().crossJoin(agents).join(best, ["agent", "path"], "left").select("agent", "path", F.coalesce("allowed", F.lit(False)).alias("allowed"))


def listed(notes: DataFrame, prefix: str | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """(path, title) under a prefix, superseded notes too, that the rules let read."""
    start = normalized(prefix)
    return notes.filter(F.col("path").startswith(start) & readable(rules, F.col("path"))).select("path", "title")
