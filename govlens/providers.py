"""Providers: who sends records, how its event names are classified, how its
feeds are named. A provider is data plus one normalizer per record kind."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame

from govlens.functions.rules import RuleBook


@dataclass(frozen=True)
class Provider:
    vendor: str
    product: str
    rules: RuleBook
    # record kind -> (feed, provider, collected_at, account) -> events
    normalizers: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    # record kind -> names that ship with the provider
    project_field: str = "claude_project_id"
    chat_field: str = "claude_chat_id"
    file_field: str = "file_id"


_REGISTRY: dict[str, Provider] = {}


def register_provider(provider: Provider) -> Provider:
    """Add a vendor; its rules must stay inside the contract's vocabularies."""
    problems = provider.rules.problems()
    if provider.rules.vendor != provider.vendor:
        problems.append(f"rules are for vendor {provider.rules.vendor!r}")
    if problems:
        raise ValueError("; ".join(problems))
    _REGISTRY[provider.vendor] = provider
    return provider


def provider(vendor: str) -> Provider:
    return _REGISTRY[vendor]


def providers() -> tuple[Provider, ...]:
    return tuple(_REGISTRY.values())


# Wire names of the shipped provider and its ordered glob rules
# (pattern, value). The first matching rule wins, so order is meaning.
VENDOR = "anthropic"
PRODUCT = "claude_enterprise"

CATEGORY_RULES = (
    ("user_signed_in_*", "authentication"),
    ("user_signed_out", "authentication"),
    ("sso_login_initiated", "authentication"),
    ("compliance_api_accessed", "data_export"),
    ("*data_export*", "data_export"),
    ("*_viewed", "content_access"),
    ("*_accessed", "content_access"),
    ("*_listed", "content_access"),
    ("claude_file_*", "content_access"),
    ("file_*", "content_access"),
    ("claude_chat_*", "content_access"),
    ("conversation_renamed", "admin_change"),
    ("conversation_deleted", "admin_change"),
    ("user_name_changed", "admin_change"),
    ("*api_key_*", "admin_change"),
    ("*_role_updated", "admin_change"),
    ("claude_code_*_updated", "admin_change"),
    ("org_*", "admin_change"),
    ("project_*", "admin_change"),
    ("rbac_*", "admin_change"),
    ("group_*", "admin_change"),
    ("platform_memory_*", "admin_change"),
    ("mcp_*", "admin_change"),
    ("integration_*", "admin_change"),
    ("extension_*", "admin_change"),
    ("billing_*", "admin_change"),
)
ACTION_RULES = (
    ("user_signed_in_*", "login"),
    ("user_signed_out", "logout"),
    ("sso_login_initiated", "login_attempt"),
    ("*_requested", "request"),
    ("*_viewed", "read"),
    ("*_accessed", "read"),
    ("*_listed", "read"),
    ("*data_export*", "export"),
    ("*_exported", "export"),
    ("*_deleted", "delete"),
    ("*_revoked", "delete"),
    ("*_removed", "delete"),
    ("*_created", "create"),
    ("*_generated", "create"),
    ("*_sent", "create"),
    ("*_installed", "create"),
    ("*_added", "create"),
    ("*_started", "create"),
    ("*_uploaded", "create"),
    ("*_updated", "update"),
    ("*_changed", "update"),
    ("*_renamed", "update"),
    ("*_toggled", "update"),
    ("*_verified", "update"),
    ("*_activated", "update"),
    ("*_deactivated", "update"),
    ("*_assigned", "update"),
    ("*_accepted", "update"),
    ("*_disabled", "update"),
    ("*_enabled", "update"),
)
RESOURCE_RULES = (
    ("project*", "project"),
    ("*api_key*", "api_key"),
    ("org_sso*", "identity"),
    ("org_jit*", "identity"),
    ("org_domain*", "identity"),
    ("sso_login_initiated", "identity"),
    ("org_user*", "user"),
    ("*_role_*", "user"),
    ("rbac*", "user"),
    ("group*", "user"),
    ("user_name_changed", "user"),
    ("claude_chat*", "chat"),
    ("conversation*", "chat"),
    ("*file*", "file"),
    ("platform_memory*", "memory"),
    ("mcp*", "integration"),
    ("integration*", "integration"),
    ("extension*", "integration"),
    ("org_*", "org"),
)
OUTCOME_RULES = (
    ("*_failed", "failure"),
    ("*_denied", "failure"),
    ("*_rejected", "failure"),
    ("*_blocked", "failure"),
)

DEFAULT_RULES = RuleBook(
    vendor=VENDOR,
    category=CATEGORY_RULES,
    action=ACTION_RULES,
    resource=RESOURCE_RULES,
    outcome=OUTCOME_RULES,
)
DEFAULT = register_provider(Provider(VENDOR, PRODUCT, DEFAULT_RULES))
