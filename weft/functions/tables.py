"""Fixed values that link audits compare with."""

from __future__ import annotations

# Attributes that hold links, by tag; "*" stands for every tag.
LINK_TAGS = {
    "a": "href", "applet": "archive src", "area": "href", "audio": "src", "bgsound": "src", "blockquote": "cite", "body": "background",
    "button": "formaction", "del": "cite", "embed": "pluginspage src", "form": "action", "frame": "src longdesc", "head": "profile",
    "html": "manifest", "iframe": "src longdesc", "ilayer": "background", "img": "src lowsrc longdesc usemap srcset",
    "input": "src usemap formaction", "ins": "cite", "isindex": "action", "layer": "background src", "link": "href", "meta": "content href",
    "object": "classid data archive usemap codebase", "q": "cite", "script": "src", "source": "src", "table": "background", "td": "background",
    "th": "background", "tr": "background", "track": "src", "video": "src", "xmp": "href", "*": "style itemtype",
}
ANCHOR_TAGS = {"a": "name", "*": "id"}
WML_TAGS = {"a": "href", "go": "href", "img": "src"}

# Content types and the parser that reads them.
PARSERS = {
    "text/html": "html", "application/xhtml+xml": "html", "application/x-httpd-php": "html", "text/css": "css",
    "application/x-shockwave-flash": "swf", "application/msword": "word", "text/plain+urls": "text", "text/plain+opera": "opera",
    "text/plain+chromium": "chromium", "application/x-plist+safari": "safari", "text/vnd.wap.wml": "wml",
    "application/xml+sitemap": "sitemap", "application/xml+sitemapindex": "sitemapindex", "application/pdf": "pdf", "application/x-pdf": "pdf",
}

# Character sets that a page may name itself.
CHARSETS = ("utf-8", "iso-8859-1", "iso-8859-15")

# Schemes by what can be said of their links; all others are unknown.
CHECKED = {"http": "http", "https": "http", "ftp": "ftp", "file": "file", "telnet": "telnet", "mailto": "mailto", "nntp": "nntp", "news": "nntp", "snews": "nntp", "dns": "dns", "itms-services": "itms-services"}
# Schemes that are fine in syntax but cannot be checked; those above are looked up first.
IGNORED = [
    "aaa", "aaas", "about", "acap", "acct", "cap", "cid", "coap", "coaps", "crid", "data", "dav", "dict", "dns", "geo", "go", "gopher", "h323", "iax",
    "icap", "im", "imap", "info", "ipp", "iris", "iris.beep", "iris.lwz", "iris.xpc", "iris.xpcs", "jabber", "ldap", "mid", "msrp", "msrps", "mtqp",
    "mupdate", "nfs", "ni", "nih", "opaquelocktoken", "pop", "pres", "reload", "rtsp", "rtsps", "rtspu", "service", "session", "shttp", "sieve",
    "sip", "sips", "sms", "snmp", "soap.beep", "soap.beeps", "stun", "stuns", "tag", "tel", "telnet", "tftp", "thismessage", "tip", "tn3270", "turn",
    "turns", "tv", "urn", "vemmi", "ws", "wss", "xcon", "xcon-userid", "xmlrpc.beep", "xmlrpc.beeps", "xmpp", "z39.50r", "z39.50s", "adiumxtra",
    "afp", "afs", "aim", "apt", "attachment", "aw", "barion", "beshare", "bitcoin", "bolo", "callto", "chrome", "chrome-extension",
    "com-eventbrite-attendee", "content", "cvs", "dlna-playcontainer", "dlna-playsingle", "dtn", "dvb", "ed2k", "facetime", "feed", "feedready",
    "finger", "fish", "gg", "git", "gizmoproject", "gtalk", "ham", "hcp", "icon", "ipn", "irc", "irc6", "ircs", "itms", "jar", "jms", "keyparc",
    "lastfm", "ldaps", "magnet", "maps", "market", "message", "mms", "ms-help", "ms-settings-power", "msnim", "mumble", "mvn", "notes", "oid", "palm",
    "paparazzi", "pkcs11", "platform", "proxy", "psyc", "query", "res", "resource", "rmi", "rsync", "rtmp", "secondlife", "sftp", "sgn", "skype",
    "smb", "smtp", "soldat", "spotify", "ssh", "steam", "submit", "svn", "teamspeak", "things", "udp", "unreal", "ut2004", "ventrilo", "view-source",
    "webcal", "wtai", "wyciwyg", "xfire", "xri", "ymsgr", "fax", "mailserver", "modem", "pack", "prospero", "snews", "videotex", "wais", "z39.50",
    "clsid", "find", "isbn", "javascript",
]

# Default ports, and heads of files by content type, in order.
PORTS = {"http": 80, "https": 443, "nntps": 563, "ftp": 21}
HEADS = [
    ("text/html", r"(?i)^<(!DOCTYPE html|html|head|title)"),
    ("text/plain+opera", r"^Opera Hotlist"),
    ("text/plain+chromium", r'^\{\s*"checksum":'),
    ("text/plain+urls", r"(?i)^# ?url list"),
    ("application/xml+sitemapindex", r"(?i)<\?xml[^<]+<sitemapindex\s+"),
    ("application/xml+sitemap", r"(?i)<\?xml[^<]+<urlset\s+"),
]
EXTENSIONS = {"html": "text/html", "htm": "text/html", "css": "text/css", "txt": "text/plain", "xml": "application/xml", "wml": "text/vnd.wap.wml", "pdf": "application/pdf", "swf": "application/x-shockwave-flash", "doc": "application/msword", "php": "application/x-httpd-php"}


def pairs(tags: dict[str, str]) -> list[tuple[str, str]]:
    return [(tag, attribute) for tag, names in tags.items() for attribute in names.split()]
