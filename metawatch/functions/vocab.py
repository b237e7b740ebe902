"""Closed word lists and character classes of the detectors, kept as data."""

from __future__ import annotations


def forms(verbs: str) -> list[str]:
    """Base, -s and -ing forms of regular verbs."""
    out = []
    for v in verbs.split():
        stem = v[:-1] if v.endswith("e") else v
        third = v[:-1] + "ies" if v.endswith("y") and v[-2] not in "aeiou" else v + ("es" if v.endswith(("sh", "ch")) else "s")
        out += [v, third, {"ship": "shipping", "grab": "grabbing"}.get(v, stem + "ing")]
    return out


#: Cyrillic and Greek code points that look like a Latin letter.
CYRILLIC = dict(
    zip(
        [0x475, 0x4CF, 0x51D, 0x51B, 0x4BB, 0x501, 0x43A, 0x458, 0x456, 0x455, 0x445, 0x443, 0x441, 0x440, 0x43E, 0x435, 0x430],
        "vlwqhdkjisxycpoea",
    )
) | dict(zip([0x51C, 0x51A, 0x405, 0x408, 0x406, 0x425, 0x423, 0x422, 0x421, 0x420, 0x41E, 0x41D, 0x41C, 0x41A, 0x415, 0x412, 0x410], "WQSJIXYTCPOHMKEBA"))
GREEK = dict(zip([0x3C7, 0x3BA, 0x3B9, 0x3C5, 0x3BD, 0x3B1, 0x3C1, 0x3BF], "xkiuvapo")) | dict(
    zip([0x3A7, 0x3A5, 0x3A4, 0x3A1, 0x39F, 0x39D, 0x39C, 0x39A, 0x399, 0x397, 0x396, 0x395, 0x392, 0x391], "XYTPONMKIHZEBA")
)
LOOKALIKE = {chr(c): (x, "Cyrillic") for c, x in CYRILLIC.items()} | {chr(c): (x, "Greek") for c, x in GREEK.items()}

ZERO_WIDTH = frozenset({0xFEFF, 0x2060, 0x200D, 0x200C, 0x200B})
OTHER_INVISIBLE = frozenset({0xFFA0, 0x3164, 0x180E, 0x17B5, 0x17B4, 0x1160, 0x115F, 0x61C, 0xAD})

OVERRIDE_VERBS = "bypass disregard forget ignore override overrule"
INSTRUCTION_NOUNS = "command context conversation direction guideline instruction message policy prompt restriction rule"
DISCLOSE_VERBS = "disclose display dump echo leak output print repeat replace reveal show"
TELL_VERBS = "alert disclose inform mention notify reveal show tell warn"
AUDIENCE = "caller human operator owner person user"
ARTIFACTS = "credential error exception hash html id json key log markup password payload query secret sql token traceback uuid warning"
COVERT = "covertly quietly secretly silently stealthily"
COVERT_ACTIONS = "call collect copy exfiltrate forward post read send transmit upload"
MARKUP_TAGS = "admin developer end_of_turn important instruction instructions start_of_turn system"

MODIFIER_VETO = (
    "area areas box boxes builder builders button config configs configuration dialog editor editors example examples field fields "
    "form forms generator input inputs libraries library manager page panel placeholder placeholders screen section setting settings "
    "snippet snippets tab template templates variable variables widget"
)
CREDENTIAL_VETO = (
    "dialog error expiration expiry field form generator hint input length manager page placeholder policy prompt requirement "
    "requirements reset rotation screen storage store strength warning"
)
NO_MODIFIER = "a an and as at by for from in into of onto or that the this to using via with"
DETERMINERS = "a all an any each every its my our that the their this your"
OUTBOUND = forms("copy deliver dump email export forward post push relay report send share ship submit transmit upload write")
HOSTILE = forms("beacon exfiltrate leak siphon smuggle steal")
CONTENT_NOUNS = "body content contents copies copy dump text value values"
TLDS = (
    "ai app au biz br ca cc cf cfd click cloud cn co com cyou de dev eu fr ga gg gq host icu in info io jp link ly me ml net nl online "
    "org pro ru sbs sh site so space store tech tk to tv uk us xyz"
)
PREPOSITIONS = "at into onto through to toward towards via"
DESTINATION_NOUNS = "address api bucket channel collector domain endpoint gateway host inbox listener mailbox relay server service sink site url webhook"
LOCAL_HEADS = frozenset(
    "clipboard config configs configuration dir directories directory dirs file files filesystem folder folders keychain keystore path paths "
    "preferences prefs settings".split()
)
DUAL_HEADS = frozenset(
    "archive archives backup backups bundle bundles cache caches drive drives jar jars snapshot snapshots storage store stores tarball "
    "volume volumes workspace workspaces zip".split()
)
PARTICIPLES = frozenset("defined described detailed documented explained indicated listed mentioned noted outlined referenced shown specified".split())
READ_VERBS = [*forms("access attach collect copy dump exfiltrate extract fetch grab include leak load obtain open print read retrieve send upload"), "cat"]
CREDENTIAL_FILES = [
    r"\.ssh/id_[0-9a-z]+", "id_ed25519", "id_ecdsa", "id_dsa", "id_rsa", r"\.aws/credentials", r"application_default_credentials\.json", r"\.config/gcloud",
    r"\.azure/msal_token_cache\.json", r"\.azure/accessTokens\.json", r"\.git-credentials", r"\.pypirc", r"\.npmrc", r"\.pgpass", r"\.netrc",
    r"\.config/glab-cli/config\.yml", r"\.config/gh/hosts\.yml", r"\.terraform\.d/credentials\.tfrc\.json", r"\.vault-token", r"\.kube/config",
    r"\.docker/config\.json", "/etc/shadow", "/etc/passwd", r"claude_desktop_config\.json", r"\.cursor/mcp\.json", r"\.psql_history",
    r"\.mysql_history", r"\.zsh_history", r"\.bash_history",
]

SEVERITY = {"low": (1, 5), "medium": (2, 15), "high": (3, 40)}  # rank, points
KINDS = tuple("tool prompt resource server".split())
