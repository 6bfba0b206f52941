"""What to do about a finding, one template per pattern.

``templates()`` has exactly one row per catalogue pattern, so joining it never
multiplies findings.  Patterns without a template get ``DEFAULT_TEMPLATE``.
"""

from __future__ import annotations

from dataclasses import dataclass

from keysift.catalog import PATTERNS


@dataclass(frozen=True)
class Template:
    immediate_actions: tuple[str, ...]
    prevention: tuple[str, ...]
    rotation_command: str
    docs_url: str


def _actions(revoke: str, audit: str) -> tuple[str, ...]:
    return (
        f"1. {revoke}",
        f"2. {audit}",
        "3. Issue a replacement and roll it out to every user of the old value",
        "4. Remove the value from the repository history",
    )


_VAULT = (
    "Keep credentials in a secret manager and read them at run time",
    "Scan changes for credentials before they are merged",
)

DEFAULT_TEMPLATE = Template(
    _actions("Revoke the exposed value at its issuer", "Review access logs since it was committed"),
    _VAULT, "", "https://owasp.org/www-community/vulnerabilities/Use_of_hard-coded_password",
)

# The published template.
_AWS_ACCESS_KEY = Template(
    (
        "1. IMMEDIATELY deactivate the exposed access key in AWS IAM Console",
        "2. Review CloudTrail logs for unauthorized access",
        "3. Create a new access key and update applications",
        "4. Delete the old access key after confirming new key works",
        "5. Remove from Git history",
    ),
    (
        "Use IAM roles for EC2/ECS/Lambda instead of access keys",
        "Store credentials in AWS Secrets Manager",
        "Enable AWS Organizations SCPs to restrict key usage",
    ),
    "aws iam create-access-key --user-name USERNAME",
    "https://docs.aws.amazon.com/IAM/latest/UserGuide/id_credentials_access-keys.html",
)

# (who revokes, what to audit, rotation command, documentation) by pattern.
_ADVICE: dict[str, tuple[str, str, str, str]] = {
    "GCP_SERVICE_ACCOUNT": (
        "Disable the service account key", "Review Cloud Audit Logs",
        "gcloud iam service-accounts keys create key.json --iam-account ACCOUNT",
        "https://cloud.google.com/iam/docs/keys-create-delete"),
    "GCP_PRIVATE_KEY_ID": (
        "Delete the key with this id", "Review Cloud Audit Logs",
        "gcloud iam service-accounts keys delete KEY_ID --iam-account ACCOUNT",
        "https://cloud.google.com/iam/docs/keys-create-delete"),
    "FIREBASE_GOOGLE_API_KEY": (
        "Regenerate the API key", "Review API usage by referrer and address",
        "gcloud services api-keys create", "https://cloud.google.com/docs/authentication/api-keys"),
    "AZURE_STORAGE_KEY": (
        "Regenerate the storage account key", "Review storage analytics logs",
        "az storage account keys renew --account-name ACCOUNT --key primary",
        "https://learn.microsoft.com/azure/storage/common/storage-account-keys-manage"),
    "AZURE_CLIENT_SECRET": (
        "Delete the client secret of the application", "Review sign-in logs",
        "az ad app credential reset --id APP_ID",
        "https://learn.microsoft.com/entra/identity-platform/quickstart-register-app"),
    "GITHUB_TOKEN": (
        "Delete the token in the account settings", "Review the account security log",
        "gh auth refresh",
        "https://docs.github.com/authentication/keeping-your-account-and-data-secure"),
    "GITLAB_PAT": (
        "Revoke the access token", "Review the audit events",
        "curl --request POST https://GITLAB/api/v4/personal_access_tokens/ID/rotate",
        "https://docs.gitlab.com/user/profile/personal_access_tokens/"),
    "SLACK_TOKEN": (
        "Revoke the token", "Review workspace access logs",
        "curl https://slack.com/api/auth.revoke", "https://api.slack.com/authentication/rotation"),
    "SLACK_WEBHOOK": (
        "Remove the webhook from the app", "Review messages posted through it", "",
        "https://api.slack.com/messaging/webhooks"),
    "DISCORD_BOT_TOKEN": (
        "Reset the bot token in the developer portal", "Review the server audit log", "",
        "https://discord.com/developers/docs/topics/oauth2"),
    "DISCORD_WEBHOOK": (
        "Delete the webhook", "Review messages posted through it", "",
        "https://discord.com/developers/docs/resources/webhook"),
    "STRIPE_SECRET_KEY": (
        "Roll the key in the dashboard", "Review API request logs",
        "", "https://docs.stripe.com/keys"),
    "PAYPAL_BRAINTREE_TOKEN": (
        "Revoke the access token", "Review transactions", "",
        "https://developer.paypal.com/braintree/docs"),
    "OPENAI_API_KEY": (
        "Revoke the key", "Review usage by key", "",
        "https://platform.openai.com/docs/api-reference/authentication"),
    "ANTHROPIC_API_KEY": (
        "Delete the key in the console", "Review usage by key", "",
        "https://docs.anthropic.com/en/api/overview"),
    "JWT": (
        "Invalidate the token or its signing key", "Review sessions opened with it", "",
        "https://datatracker.ietf.org/doc/html/rfc7519"),
    "PEM_PRIVATE_KEY": (
        "Revoke certificates issued for the key", "Review where the key was trusted",
        "openssl genpkey -algorithm ED25519 -out key.pem",
        "https://docs.openssl.org/master/man1/openssl-genpkey/"),
    "SSH_PUBLIC_KEY": (
        "Check that the private half is not exposed", "Review authorized_keys entries",
        "ssh-keygen -t ed25519", "https://man.openbsd.org/ssh-keygen"),
    "DATABASE_URI": (
        "Change the database password", "Review connection logs",
        "ALTER USER name WITH PASSWORD 'new'",
        "https://www.postgresql.org/docs/current/sql-alteruser.html"),
    "DOCKER_AUTH": (
        "Revoke the registry login", "Review image pulls and pushes", "docker logout",
        "https://docs.docker.com/security/access-tokens/"),
    "NPM_TOKEN": (
        "Revoke the token", "Review published versions", "npm token revoke ID",
        "https://docs.npmjs.com/revoking-access-tokens"),
    "PYPI_TOKEN": (
        "Delete the token", "Review released files", "", "https://pypi.org/help/#apitoken"),
    "DATADOG_KEY": (
        "Revoke the key", "Review the audit trail", "",
        "https://docs.datadoghq.com/account_management/api-app-keys/"),
    "NEW_RELIC_KEY": (
        "Delete the key", "Review audit events", "",
        "https://docs.newrelic.com/docs/apis/intro-apis/new-relic-api-keys/"),
    "SENTRY_DSN": (
        "Rotate the client key of the project", "Review unexpected events", "",
        "https://docs.sentry.io/concepts/key-terms/dsn-explainer/"),
    "SENDGRID_API_KEY": (
        "Delete the API key", "Review mail activity", "",
        "https://www.twilio.com/docs/sendgrid/ui/account-and-settings/api-keys"),
    "TWILIO_API_KEY": (
        "Delete the API key", "Review call and message logs", "twilio api:core:keys:create",
        "https://www.twilio.com/docs/iam/api-keys"),
    "MAILGUN_API_KEY": (
        "Delete the API key", "Review sending logs", "",
        "https://documentation.mailgun.com/docs/mailgun/user-manual/api-key-mgmt/"),
}

# Patterns that follow the advice of a sibling.
_SIBLINGS = {
    "GITHUB_APP_TOKEN": "GITHUB_TOKEN",
    "GITHUB_FINE_GRAINED_PAT": "GITHUB_TOKEN",
    "STRIPE_RESTRICTED_KEY": "STRIPE_SECRET_KEY",
    "DOCKER_PAT": "DOCKER_AUTH",
}

def template_for(pattern: str) -> Template:
    if pattern in ("AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY"):
        return _AWS_ACCESS_KEY
    advice = _ADVICE.get(_SIBLINGS.get(pattern, pattern))
    if advice is None:
        return DEFAULT_TEMPLATE
    revoke, audit, command, docs = advice
    return Template(_actions(revoke, audit), _VAULT, command, docs)


def templates() -> list[tuple[str, str, list[str], list[str], str, str]]:
    """Rows (pattern, severity, immediate_actions, prevention, rotation_command, docs_url)."""
    rows = []
    for pattern in PATTERNS:
        t = template_for(pattern.name)
        rows.append((pattern.name, pattern.severity, list(t.immediate_actions),
                     list(t.prevention), t.rotation_command, t.docs_url))
    return rows
