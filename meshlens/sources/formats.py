"""Text formats of the dumps and files this package reads.

Fixed values: they describe what the routers print, so they cannot be chosen freely.
Patterns are Java regular expressions; ``(?U)`` makes ``\\w \\s \\b`` cover Unicode, and
``\\x1f`` is added wherever white space is meant because Unicode does not class it as such.
"""

# Line breaks and white space -------------------------------------------------------------
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
OTHER_BREAK = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACES = r"(?U)[\s\x1f]+"
NON_WORDS = r"(?U)[^\w]+"

# Whole dump ------------------------------------------------------------------------------
END_OF_DUMP = "End of Sysinfo Output"
CLOCK_PREFIX = "page generated on"
CLOCK_STAMP = (
    r"(?iU)^(?:mon|tue|wed|thu|fri|sat|sun)[\s\x1f]+([a-z]{3})[\s\x1f]+(\d{1,2})[\s\x1f]+"
    r"(\d{1,2}:\d{1,2}:\d{1,2})[\s\x1f]+(?:utc|gmt)[\s\x1f]+(\d{4})$"
)
CLOCK_FORMAT = "MMM d H:m:s yyyy z"

# Section markers -------------------------------------------------------------------------
DEVICE_MARKER = "show_devices:"
WLAN_MARKER = "wlan_report"
BACKHAUL_MARKER = "bh_report"
DEVINFO_MARKER = "cat /tmp/msg/DEVINFO/*"
COMMAND_PREFIX = "cat "
NEIGHBOR_MARKER = "ip neigh:"
NIC_MARKER = "NIC Counters"
BANNER_PREFIX = "===="
TITLE_PREFIX = "-----"
SEPARATOR_WITHIN = 4

DASH_ROW = r"^[ \t]*-{3,}(?:[ \t]+-{3,})*[ \t]*$"
DASH_TITLE = r"(?U)^-{5,}[\s\x1f]+.+[\s\x1f]+-{5,}[\s\x1f]*$"
STATS_TITLE = r"(?U)^-{5,}[\s\x1f]+wifi apstats section[\s\x1f]+-{5,}[\s\x1f]*$"
CONFIG_TITLE = r"(?U)^-{5,}[\s\x1f]+(ath\w+)[\s\x1f]+Settings[\s\x1f]+-{5,}[\s\x1f]*$"
LLDP_TITLE = r"(?U)^=+[\s\x1f]+LLDP Information[\s\x1f]+=+[\s\x1f]*$"
PING_TITLE = r"(?U)^---[\s\x1f]+(.+?)[\s\x1f]+ping statistics[\s\x1f]+---[\s\x1f]*$"

# Row shapes ------------------------------------------------------------------------------
DITTO_ROW = r'(?U)^[\s\x1f]*"'
DEVICE_ROW = r'(?U)^(?:[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-|[\s\x1f]*")'
WLAN_ROW = r"(?U)^[0-9a-fA-F]{2}(?::[0-9a-fA-F]{2}){5}\b"
BACKHAUL_ROW = r"(?U)^[0-9A-Fa-f]{12}\b"
NIC_ROW = r"(?U)^[\s\x1f]*([^\s\x1f]+)[\s\x1f]*:[\s\x1f]*RX bytes:(\d+).*?TX bytes:(\d+)"
NEIGHBOR_ROW = (
    r"(?U)^([0-9a-fA-F:.]+)[\s\x1f]+dev[\s\x1f]+([^\s\x1f]+)"
    r"(?:[\s\x1f]+lladdr[\s\x1f]+([0-9a-fA-F]{2}(?::[0-9a-fA-F]{2})+))?"
    r"((?:[\s\x1f]+[a-z_]+)*)"
    r"(?:[\s\x1f]+([A-Z][A-Z_]+))?[\s\x1f]*$"
)
NEIGHBOR_ROUTER_FLAG = "router"
STATS_BAND = r"(?U)^radio level information of[\s\x1f]+(.+?):[\s\x1f]*$"
STATS_RADIO = r"(?U)^Radio Level Stats:[\s\x1f]+([^\s\x1f]+)"
KEY_VALUE = r"(?U)^([^\s\x1f].*?)[\s\x1f]*=[\s\x1f]*(.+?)[\s\x1f]*$"
CONFIG_TOKEN = r"(?U)\b(?:get_|g_)(\w+):([^\s\x1f]+)"
CONFIG_SSID = "SSID:"
CONFIG_MAC = "Mac address:"
CONFIG_FREQUENCY = "Frequency:"
PING_WITHIN = 4
PING_COUNTS = (
    r"(?U)(\d+)[\s\x1f]+packets transmitted,[\s\x1f]+(\d+)[\s\x1f]+(?:packets[\s\x1f]+)?received"
    r".*?([\d.]+)%[\s\x1f]+packet loss"
)
PING_TIMES = (
    r"(?U)(?:round-trip|rtt)[\s\x1f]+min/avg/max(?:/mdev)?[\s\x1f]*=[\s\x1f]*"
    r"([\d.]+)/([\d.]+)/([\d.]+)"
)
UPTIME = (
    r"(?U)\bup[\s\x1f]+(?:(\d+)[\s\x1f]+days?,[\s\x1f]+)?"
    r"(?:(\d+):(\d+)|(\d+)[\s\x1f]+min)"
)
LOAD_AVERAGE = r"(?U)load average:[\s\x1f]+([\d.]+),[\s\x1f]+([\d.]+),[\s\x1f]+([\d.]+)"
MEMORY = (
    r"(?U)^Mem:[\s\x1f]+(\d+)[\s\x1f]+(\d+)[\s\x1f]+(\d+)[\s\x1f]+"
    r"(\d+)[\s\x1f]+(\d+)[\s\x1f]+(\d+)"
)
CPU_IDLE = r"(?U)^CPU:.*?([\d.]+)%[\s\x1f]+idle"
LLDP_NEIGHBOR = r"(?U)^Interface:[\s\x1f]+([^,]+),.*?RID:[\s\x1f]+(\d+)"
LLDP_CHASSIS = "ChassisID:"
LLDP_SYS_NAME = "SysName:"
LLDP_SYS_DESCR = "SysDescr:"
LLDP_MGMT_IP = "MgmtIP:"
LLDP_PORT = "PortID:"
LLDP_PORT_DESCR = "PortDescr:"
LLDP_CAPABILITY = "Capability:"
LLDP_ID_PREFIX = "mac "
LLDP_ENABLED = "on"

# Texts that every line of these shapes contains.
NEIGHBOR_HINT = "dev"
PING_HINT = "ping statistics"
UPTIME_HINT = "up"
LOAD_HINT = "load average:"
MEMORY_HINT = "Mem:"
CPU_HINT = "idle"
LLDP_HINT = "LLDP Information"

# A string, an unfinished string, a brace or plain text: the pieces of concatenated JSON ----
JSON_PIECE = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|".*|[{}]|[^"{}]++'

# Node information keys ---------------------------------------------------------------------
NODE_ROLES = ("master", "slave")
DEVINFO_FIELDS = {
    "sku": "SKU",
    "serial_number": "serialNumber",
    "fw_ver": "fw_ver",
    "mode": "mode",
    "model_base": "model_base",
    "model_number": "model_number",
    "hw_version": "hw_version",
}
DEVINFO_RADIO_FIELDS = (
    "userAp2G_bssid",
    "userAp2G_channel",
    "userAp5GL_bssid",
    "userAp5GL_channel",
    "userAp5GH_bssid",
    "userAp5GH_channel",
)

# Numbers as text -----------------------------------------------------------------------------
INTEGER_TEXT = r"^[+-]?[0-9]+(?:_[0-9]+)*$"
FLOAT_TEXT = (
    r"^[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)"
    r"(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?$"
)
LEADING_ZEROS = r"^(-?)0+(?=[0-9])"
SPECIAL_FLOAT_TEXT = r"(?i)^[+-]?(?:nan|inf|infinity)$"

# Replay buffer -------------------------------------------------------------------------------
BUFFER_FILE = r"^(.+)\.[0-9]{8}_[0-9]{6}(?:-[0-9]+)?$"
BUFFER_TIME_KEY = "__dt_ms__"
