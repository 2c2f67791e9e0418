"""The shipped detection rules."""

from __future__ import annotations

from threatframe.operators.rules import Rule

SQLI = r"union\s+select|('\s*(or|and)\s*'?[0-9']|\bor\s+1\s*=\s*1)|--\s*$|;\s*drop\s+table|sleep\s*\("
TRAVERSAL = r"\.\./|/etc/(passwd|shadow)|boot\.ini|%2e%2e%2f"
XSS = r"<script\b|javascript:|onerror\s*="
INJECTION = r";\s*(cat|id|whoami|wget|curl)\b|\|\s*(cat|id|whoami)\b|\$\((?:cat|id|whoami)\)"
POWERSHELL = r"encodedcommand|\-enc\s|iex\b|invoke-expression|downloadstring|invoke-webrequest"
DOWNLOAD = r"(wget|curl)\s+https?://.*(\.(sh|exe|bin|ps1)|-O\s+/tmp)"
PERSISTENCE = r"/etc/(cron|rc\.local|systemd)|schtasks\s+/create|reg\s+add.*CurrentVersion\\Run"
LONG_LABEL = r"[A-Za-z0-9-]{30,}\."
WEB = ("http_request", "proxy_request")

#: Rule ids, names, thresholds and windows. windows logons match on win_event_id.
RULES = [
    Rule("BRUTE_FORCE_001", "SSH/Linux Brute Force (failed logins)", "Brute Force", "HIGH", {"event_type": "auth_failure"}, threshold=3, then_success=True),
    Rule("WIN_LOGON_BURST_001", "Windows Failed Logon Burst (4625)", "Brute Force", "HIGH", {"event_type": "windows_event", "win_event_id": 4625}, threshold=3, window="10m", then_success=True),
    Rule("PRIV_ESC_001", "Privilege Escalation Command", "Privilege Escalation", "MEDIUM", {"event_type": "privilege_escalation"}, group_by=("username",)),
    Rule("PORT_SCAN_001", "Port Scan (many ports denied)", "Port Scanning", "HIGH", {"event_type": "firewall_event"}, ("deny", "blocked", "block"), metric="distinct", distinct_field="dst_port", threshold=6, window="10m"),
    Rule("HOST_SCAN_001", "Network Scan (many hosts)", "Reconnaissance", "MEDIUM", {"event_type": "firewall_event"}, metric="distinct", distinct_field="dst_ip", threshold=5, window="10m"),
    Rule("IDS_ALERT_BURST_001", "IDS Alert Burst", "Reconnaissance", "MEDIUM", {"event_type": "ids_alert"}, threshold=3, window="15m"),
    Rule("WEB_SQLI_001", "Possible SQL Injection", "Web Attack", "HIGH", event_types=WEB, regex=SQLI, window="30m"),
    Rule("WEB_TRAVERSAL_001", "Possible Path Traversal", "Web Attack", "HIGH", event_types=WEB, regex=TRAVERSAL, window="30m"),
    Rule("WEB_XSS_001", "Possible XSS Attempt", "Web Attack", "MEDIUM", event_types=WEB, regex=XSS, window="30m"),
    Rule("WEB_CMD_INJ_001", "Possible Command Injection", "Web Attack", "CRITICAL", event_types=WEB, regex=INJECTION, window="30m"),
    Rule("MAL_POWERSHELL_001", "Suspicious PowerShell Execution", "Command Execution", "CRITICAL", regex=POWERSHELL, group_by=("src_ip", "username"), window="60m"),
    Rule("MAL_DOWNLOAD_EXEC_001", "Download-and-Execute Pattern", "Malware", "HIGH", regex=DOWNLOAD, group_by=("username",), window="60m"),
    Rule("MAL_PERSISTENCE_001", "Persistence Mechanism Modification", "Persistence", "HIGH", regex=PERSISTENCE, window="60m"),
    Rule("CLOUD_IAM_001", "Cloud IAM Activity Burst", "Credential Attack", "MEDIUM", {"event_type": "cloud_event"}, threshold=5, window="10m"),
    Rule("EDR_MALWARE_001", "CrowdStrike Falcon High-Severity Detection", "Malware", "CRITICAL", {"event_type": "edr_event"}, ("failure", "denied", "blocked"), group_by=("hostname", "src_ip"), window="10m"),
    Rule("DNS_TUNNEL_001", "DNS Exfiltration / Tunneling (long label queries)", "Data Exfiltration", "HIGH", {"event_type": "dns_query"}, regex=LONG_LABEL, threshold=5),
    Rule("OT_ALARM_001", "Industrial Sensor Alarm / Fault", "Unknown", "HIGH", {"event_type": "ot_sensor_event"}, ("failure",), group_by=("hostname",), window="10m"),
    Rule("VMW_ESXI_LOGIN_BURST_001", "VMware ESXi Failed Login Burst", "Brute Force", "HIGH", {"event_type": "auth_failure", "source": "vmware-esxi"}, group_by=("src_ip", "username"), threshold=3),
    Rule("VMW_VCENTER_LOGIN_BURST_001", "vCenter Authentication Failure Burst", "Brute Force", "HIGH", {"event_type": "auth_failure", "source": "vmware-vcenter"}, threshold=3, window="10m"),
    Rule("VMW_NSX_FIREWALL_SCAN_001", "NSX-T Firewall Drop Burst", "Port Scanning", "HIGH", {"event_type": "firewall_event"}, ("deny",), metric="distinct", distinct_field="dst_port", threshold=6, window="10m"),
]

#: Rule -> (technique, tactic); tactics in their order.
TACTICS = ["reconnaissance", "resource-development", "initial-access", "execution", "persistence", "privilege-escalation", "defense-evasion", "credential-access", "discovery", "lateral-movement", "collection", "command-and-control", "exfiltration", "impact"]

TECHNIQUES = {
    "BRUTE_FORCE_001": [("T1110.001", "credential-access")],
    "WIN_LOGON_BURST_001": [("T1110.003", "credential-access")],
    "PRIV_ESC_001": [("T1548.003", "privilege-escalation")],
    "PORT_SCAN_001": [("T1046", "discovery")],
    "HOST_SCAN_001": [("T1018", "discovery")],
    "IDS_ALERT_BURST_001": [("T1595", "reconnaissance")],
    "WEB_SQLI_001": [("T1190", "initial-access")],
    "WEB_TRAVERSAL_001": [("T1083", "discovery")],
    "WEB_XSS_001": [("T1059.007", "execution")],
    "WEB_CMD_INJ_001": [("T1059", "execution")],
    "MAL_POWERSHELL_001": [("T1059.001", "execution")],
    "MAL_DOWNLOAD_EXEC_001": [("T1105", "command-and-control")],
    "MAL_PERSISTENCE_001": [("T1547", "persistence")],
    "CLOUD_IAM_001": [("T1078.004", "defense-evasion"), ("T1586", "resource-development")],
    "EDR_MALWARE_001": [("T1059", "execution"), ("T1562.001", "defense-evasion")],
    "DNS_TUNNEL_001": [("T1071.004", "command-and-control"), ("T1048.003", "exfiltration")],
    "OT_ALARM_001": [("T0831", "impact")],
    "VMW_ESXI_LOGIN_BURST_001": [("T1110.001", "credential-access")],
    "VMW_VCENTER_LOGIN_BURST_001": [("T1110.003", "credential-access")],
    "VMW_NSX_FIREWALL_SCAN_001": [("T1046", "discovery")],
}
