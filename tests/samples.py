"""One made-up credential per pattern, put together here so that none is stored."""

HEX = "0f3a9c4e7b1d2586" * 8
ALNUM = "aB3dE5gH7jK9mN1pQ2sT4vW6xY8zC0fL" * 8
UPPER = "Q7W9E2R4T6Y8U1I3" * 4

# pattern name -> (text before, secret, text after)
POSITIVE = {
    "AWS_ACCESS_KEY_ID": ("id ", "AK" + "IA" + UPPER[:16], ";"),
    "AWS_SECRET_ACCESS_KEY": ("aws_sec" + "ret_access_key = \"", ALNUM[:40], "\""),
    "GCP_SERVICE_ACCOUNT": ("{", '"type": "service' + '_account"', "}"),
    "GCP_PRIVATE_KEY_ID": ('"private_' + 'key_id": "', HEX[:40], '"'),
    "FIREBASE_GOOGLE_API_KEY": ("k=", "AI" + "za" + ALNUM[:35], ""),
    "AZURE_STORAGE_KEY": ("Account" + "Key=", ALNUM[:86] + "==", ";"),
    "AZURE_CLIENT_SECRET": ("azure_client_sec" + "ret: ", "q~" + ALNUM[:34], ""),
    "GITHUB_TOKEN": ("", "gh" + "p_" + ALNUM[:36], ""),
    "GITHUB_APP_TOKEN": ("", "gh" + "s_" + ALNUM[:36], ""),
    "GITHUB_FINE_GRAINED_PAT": ("", "github" + "_pat_" + ALNUM[:40], ""),
    "GITLAB_PAT": ("", "gl" + "pat-" + ALNUM[:20], ""),
    "SLACK_TOKEN": ("", "xo" + "xb-" + ALNUM[:30], ""),
    "SLACK_WEBHOOK": (
        "", "https://hooks.sla" + "ck.com/services/T" + UPPER[:8] + "/B" + UPPER[:8] + "/"
        + ALNUM[:24], ""),
    "DISCORD_BOT_TOKEN": ("", "M" + ALNUM[:23] + "." + ALNUM[:6] + "." + ALNUM[:27], ""),
    "DISCORD_WEBHOOK": (
        "", "https://dis" + "cord.com/api/webhooks/" + "1" * 18 + "/" + ALNUM[:64], ""),
    "STRIPE_SECRET_KEY": ("", "sk" + "_live_" + ALNUM[:24], ""),
    "STRIPE_RESTRICTED_KEY": ("", "rk" + "_live_" + ALNUM[:24], ""),
    "PAYPAL_BRAINTREE_TOKEN": (
        "", "access_" + "token$production$" + HEX[:16] + "$" + HEX[:32], ""),
    "OPENAI_API_KEY": ("key ", "sk" + "-" + ALNUM[:48], " "),
    "ANTHROPIC_API_KEY": ("", "sk" + "-ant-" + ALNUM[:40], ""),
    "JWT": ("Bearer ", "ey" + "J" + ALNUM[:12] + "." + ALNUM[:20] + "." + ALNUM[:20], ""),
    "PEM_PRIVATE_KEY": (
        "", "-----BEGIN RSA PRIV" + "ATE KEY-----\n" + ALNUM[:64] + "\n" + HEX[:20]
        + "==\n-----END RSA PRIV" + "ATE KEY-----", ""),
    "SSH_PUBLIC_KEY": ("", "ssh-" + "rsa " + ALNUM[:70] + "==", " me@host"),
    "DATABASE_URI": ("post" + "gres://user:", "p" + HEX[:14], "@db.host/name"),
    "DOCKER_AUTH": ('"au' + 'th": "', ALNUM[:24] + "==", '"'),
    "DOCKER_PAT": ("", "dckr" + "_pat_" + ALNUM[:27], ""),
    "NPM_TOKEN": ("", "np" + "m_" + ALNUM[:36], ""),
    "PYPI_TOKEN": ("", "py" + "pi-" + ALNUM[:60], ""),
    "DATADOG_KEY": ("DD_" + "API_KEY=", HEX[:32], ""),
    "NEW_RELIC_KEY": ("", "NR" + "AK-" + UPPER[:27], ""),
    "SENTRY_DSN": ("", "https://" + HEX[:32] + "@o1.ingest.sen" + "try.io/42", ""),
    "SENDGRID_API_KEY": ("", "S" + "G." + ALNUM[:22] + "." + ALNUM[:43], ""),
    "TWILIO_API_KEY": ("sid ", "S" + "K" + HEX[:32], " "),
    "MAILGUN_API_KEY": ("mail ", "key" + "-" + HEX[:32], " "),
    "GENERIC_ASSIGNMENT": ("PassWord : '", ALNUM[:20], "'"),
}


def line(name):
    return "".join(POSITIVE[name])


def near_miss(name):
    """The sample with the end of its secret cut off or its frame broken."""
    before, secret, after = POSITIVE[name]
    if name == "GCP_SERVICE_ACCOUNT":
        return '"type": "authorized_user"'
    if name == "PEM_PRIVATE_KEY":
        return secret.split("-----END")[0]
    if name == "SLACK_TOKEN":
        return before + secret[:13]
    if name == "AZURE_STORAGE_KEY":
        return before + secret[:-2]
    if name == "DOCKER_AUTH":
        return before + secret[:10] + after
    if name == "DATABASE_URI":
        return before + secret
    if name == "SENTRY_DSN":
        return secret.replace("sen" + "try.io", "example.org")
    if name == "JWT":
        return before + ".".join(secret.split(".")[:2])
    if name == "SSH_PUBLIC_KEY":
        return secret[:40]
    if name == "OPENAI_API_KEY":
        return "a" + secret + after
    if name == "GENERIC_ASSIGNMENT":
        return before + secret[:15] + after
    if name in ("STRIPE_SECRET_KEY", "STRIPE_RESTRICTED_KEY"):
        return secret[:20]
    if name == "GITHUB_FINE_GRAINED_PAT":
        return secret[:20]
    if name == "ANTHROPIC_API_KEY":
        return secret[:25]
    if name == "PYPI_TOKEN":
        return secret[:40]
    if name == "AZURE_CLIENT_SECRET":
        return before + secret[:30]
    if name == "DISCORD_WEBHOOK":
        return secret[:80]
    if name == "SLACK_WEBHOOK":
        return secret[:-6]
    if name == "NPM_TOKEN":
        return secret[:-1]
    return before + secret[:-1] + after
