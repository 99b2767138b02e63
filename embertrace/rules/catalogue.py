"""The 51 shipped rules.

Rule ids, event types, severities, ATT&CK ids and match values are fixed values: detection
results depend on each. Names and descriptions are ours.
"""

from __future__ import annotations

from functools import cache

from embertrace.rules.model import Condition, Rule


def _one_or_any(field: str, single: str, values: tuple[str, ...], **kw) -> Condition:
    if len(values) == 1:
        return Condition(field, single, value=values[0], **kw)
    return Condition(field, f"{single}_any", values=values, **kw)


def ends(field: str, *values: str) -> Condition:
    return _one_or_any(field, "ends_with", values)


def has(field: str, *values: str) -> Condition:
    return Condition(field, "contains_any", values=values)


def lacks(field: str, *values: str, null_ok: bool = False) -> Condition:
    return Condition(field, "not_contains_any", values=values, allow_null=null_ok)


def lacks_one(field: str, value: str) -> Condition:
    return Condition(field, "not_contains", value=value)


def not_ending(field: str, *values: str) -> Condition:
    return Condition(field, "not_ends_with_any", values=values)


def bits(field: str, *masks: str) -> Condition:
    return Condition(field, "bits_any_set", values=masks)


def equals(field: str, value: str) -> Condition:
    return Condition(field, "equals", value=value)


def matches(field: str, pattern: str) -> Condition:
    return Condition(field, "regex", value=pattern)


def rule(rule_id: str, eid: int, severity: str, tactic: str, technique: str, name: str, *conds: Condition) -> Rule:
    return Rule(
        id=rule_id, event_ids=(eid,), severity=severity, mitre_tactic=tactic,
        mitre_technique=technique, conditions=conds, name=name, description=f"{name} ({technique}).",
    )


EVASION, EXECUTION, C2 = "Defense Evasion", "Execution", "Command and Control"
PERSISTENCE, ACCESS = "Persistence", "Initial Access"

# --- fixed values shared by several rules ---------------------------------------------------
OFFICE = ("winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "onenote.exe")
SCRIPT_HOSTS = ("wscript.exe", "cscript.exe")
SCRIPT_ENGINES = ("wscript.exe", "cscript.exe", "mshta.exe")
TASK_HOSTS = ("taskeng.exe", "taskhostw.exe")
TASK_SCRIPTS = ("powershell.exe", "wscript.exe", "cscript.exe", "mshta.exe")
SHELLS = ("cmd.exe", "powershell.exe", "wscript.exe", "cscript.exe")
WEB_PORTS = "^(80|443)$"
OUTBOUND = equals("initiated", "true")
UNSIGNED = equals("signed", "false")
POWERSHELL = ends("image", "powershell.exe")
NOT_TEST_PYTHON = lacks_one("source_image", "python_runtime\\python.exe")


def _api_memory() -> list[Rule]:
    return [
        rule(
            "API_CRT_SUSPICIOUS_SOURCE_001", 8, "Critical", EVASION, "T1055",
            "Remote thread started by an unlikely program",
            ends("source_image", "\\winword.exe", "\\excel.exe", "\\powerpnt.exe", "\\outlook.exe", "\\lync.exe", "\\mspaint.exe",
            "\\powershell.exe", "\\wscript.exe", "\\mshta.exe", "\\msiexec.exe", "\\regsvr32.exe", "\\wmic.exe", "\\installutil.exe",
            "\\schtasks.exe", "\\iexplore.exe", "\\msbuild.exe", "\\cvtres.exe", "\\vssadmin.exe", "\\find.exe", "\\findstr.exe",
            "\\forfiles.exe", "\\expand.exe", "\\defrag.exe", "\\ping.exe", "\\robocopy.exe", "\\makecab.exe", "\\gpupdate.exe", "\\hh.exe",
            "\\explorer.exe", "\\monitoringhost.exe"),
            NOT_TEST_PYTHON,
        ),
        rule(
            "API_CRT_SENSITIVE_TARGET_001", 8, "High", EVASION, "T1055",
            "Remote thread into a protected system process",
            ends("target_image", "\\lsass.exe", "\\winlogon.exe", "\\csrss.exe"),
            not_ending("source_image", "\\csrss.exe", "\\werfault.exe", "\\svchost.exe", "\\wmiprvse.exe", "\\vmtoolsd.exe", "\\MsMpEng.exe",
            "\\lsass.exe", "\\winlogon.exe", "\\wininit.exe", "\\services.exe"),
            NOT_TEST_PYTHON,
        ),
        rule(
            "API_OPEN_PROCESS_SUSPICIOUS_ACCESS_001", 10, "High", EVASION, "T1055",
            "Broad handle on a protected system process",
            bits("granted_access", "0x1f0fff", "0x1410", "0x1fffff"),
            ends("target_image", "lsass.exe", "winlogon.exe", "csrss.exe"),
            not_ending(
                "source_image", "MsMpEng.exe",
                "\\Windows\\System32\\csrss.exe", "\\Windows\\System32\\lsass.exe", "\\Windows\\System32\\winlogon.exe",
                "\\Windows\\System32\\wininit.exe", "\\Windows\\System32\\svchost.exe", "\\Windows\\System32\\wbem\\wmiprvse.exe",
                "\\Program Files\\VMware\\VMware Tools\\vmtoolsd.exe",
            ),
        ),
        rule(
            "API_DLL_LOAD_SUSPICIOUS_PATH_001", 7, "High", EVASION, "T1055.001",
            "Unsigned library from a folder users can write",
            has("image_loaded", "\\temp\\", "\\appdata\\local\\temp\\", "\\appdata\\roaming\\",
                "\\downloads\\", "\\programdata\\", "c:\\users\\public\\"),
            UNSIGNED,
        ),
        rule(
            "API_LOLBIN_DLL_UNSIGNED_001", 7, "High", EVASION, "T1055.001",
            "Unsigned library in a proxy binary",
            ends("image", "rundll32.exe", "regsvr32.exe", "mshta.exe", "msiexec.exe", "cmstp.exe"),
            UNSIGNED,
        ),
        rule(
            "API_OPEN_PROCESS_VM_WRITE_001", 10, "Critical", EVASION, "T1055",
            "Write access to another program's memory",
            bits("granted_access", "0x0028", "0x001f0fff"),
            not_ending(
                "source_image", "MsMpEng.exe",
                "\\Windows\\System32\\csrss.exe", "\\Windows\\System32\\lsass.exe", "\\Windows\\System32\\winlogon.exe",
                "\\Windows\\System32\\wininit.exe", "\\Windows\\System32\\werfault.exe", "\\Windows\\System32\\svchost.exe",
                "\\Windows\\System32\\services.exe",
                "\\Windows\\Sysmon64.exe",
                "\\Windows\\System32\\runonce.exe", "\\Windows\\System32\\conhost.exe", "\\Windows\\System32\\cmd.exe",
            ),
            Condition("source_image", "not_same_basename", reference_field="target_image"),
            not_ending("target_image", "\\Windows\\Microsoft.NET\\Framework64\\v4.0.30319\\csc.exe",
            "\\Windows\\Microsoft.NET\\Framework64\\v4.0.30319\\cvtres.exe"),
            lacks(
                "call_trace", "System.Management.Automation.ni.dll",
                "Microsoft.PowerShell.Commands.Management.ni.dll", "System.Management.Automation.dll",
                null_ok=True,
            ),
        ),
        rule(
            "API_TOKEN_MANIPULATION_001", 10, "High", EVASION, "T1134",
            "Handle duplication on a token holder",
            bits("granted_access", "0x0040", "0x0440", "0x1440"),
            ends("target_image", "lsass.exe", "winlogon.exe", "services.exe"),
            not_ending("source_image", "msmpeng.exe", "csrss.exe", "lsass.exe", "winlogon.exe", "wininit.exe"),
        ),
        rule(
            "API_AV_PROCESS_ACCESS_001", 10, "High", EVASION, "T1562.001",
            "Handle on a security product",
            ends("target_image", "msmpeng.exe", "mpcmdrun.exe", "avgnt.exe", "avp.exe", "bdagent.exe",
                 "ekrn.exe", "sentinelagent.exe", "cylancesvc.exe", "cb.exe"),
            bits("granted_access", "0x0001", "0x0020"),
            not_ending(
                "source_image", "msmpeng.exe", "svchost.exe", "services.exe", "trustedinstaller.exe",
                "tiworker.exe", "sgrmbroker.exe", "wuauclt.exe", "csrss.exe", "conhost.exe", "lsass.exe",
                "winlogon.exe", "wininit.exe",
            ),
        ),
    ]


def _proxy_binaries() -> list[Rule]:
    def proxy(rule_id, severity, technique, text, image, *markers, tactic=EVASION):
        conds = [ends("image", *image)]
        if markers:
            conds.append(has("command_line", *markers))
        return rule(rule_id, 1, severity, tactic, technique, text, *conds)

    return [
        proxy("LOLBIN_MSHTA_001", "High", "T1218.005", "mshta started", ("mshta.exe",)),
        proxy("LOLBIN_RUNDLL32_SUSPICIOUS_001", "High", "T1218.011", "rundll32 with a script or remote argument",
              ("rundll32.exe",), "javascript:", "shell32.dll,ShellExec", "shell32.dll,Control_RunDLL",
              "http://", "https://"),
        proxy("LOLBIN_REGSVR32_001", "High", "T1218.010", "regsvr32 with a remote script", ("regsvr32.exe",),
              "/i:http", "/i:https", "/s /u /i", "scrobj.dll"),
        proxy("LOLBIN_CERTUTIL_001", "Medium", "T1140", "certutil decoding or fetching", ("certutil.exe",),
              "-decode", "-decodehex", "-urlcache", "-f http", "-f https"),
        proxy("LOLBIN_MSIEXEC_REMOTE_001", "High", "T1218.007", "msiexec with a remote package", ("msiexec.exe",),
              "http://", "https://", "ftp://", "/i http", "/i ftp", "/package http"),
        proxy("LOLBIN_ODBCCONF_001", "High", "T1218.008", "odbcconf registering a library", ("odbcconf.exe",),
              "regsvr", "/a {", "-a {", "/f http", "/f ftp"),
        proxy("LOLBIN_CMSTP_001", "High", "T1218.003", "cmstp started", ("cmstp.exe",)),
        proxy("LOLBIN_HH_CHM_001", "High", "T1218.001", "hh opening remote or script content", ("hh.exe",),
              "http://", "https://", "javascript:", "mk:@msitstore:", "ftp://"),
        proxy("LOLBIN_REGASM_REGSVCS_001", "High", "T1218.009", "regasm or regsvcs started", ("regasm.exe", "regsvcs.exe")),
        proxy("LOLBIN_WMIC_PROCESS_001", "High", "T1047", "wmic creating or querying processes", ("wmic.exe",),
              "process call create", "call create", "process where", "/node:", "win32_process",
              tactic=EXECUTION),
        proxy("LOLBIN_BITSADMIN_001", "Medium", "T1197", "bitsadmin transfer", ("bitsadmin.exe",),
              "/transfer", "/addfile", "http://", "https://", "ftp://"),
        proxy("LOLBIN_INSTALLUTIL_001", "High", "T1218.004", "InstallUtil started", ("installutil.exe",)),
        proxy("LOLBIN_FORFILES_001", "Medium", "T1216", "forfiles running a shell", ("forfiles.exe",),
              "cmd", "powershell", "wscript", "cscript", "mshta", "/c cmd", "/c powershell"),
    ]


def _network() -> list[Rule]:
    web = matches("destination_port", WEB_PORTS)
    return [
        rule("NET_POWERSHELL_HTTP_001", 3, "High", C2, "T1071.001", "PowerShell reaching the web",
             POWERSHELL, OUTBOUND, web,
             lacks("destination_hostname", ".microsoft.com", ".windowsupdate.com",
                   ".powershellgallery.com", ".office.com", ".office365.com", ".windows.com",
                   ".visualstudio.com", ".nuget.org", ".azure.com", ".live.com", null_ok=True)),
        rule("NET_SCRIPTING_ENGINE_HTTP_001", 3, "High", C2, "T1071.001", "Script host reaching the web",
             ends("image", *SCRIPT_HOSTS), OUTBOUND, web),
        rule("NET_LOLBIN_PROCESS_HTTP_001", 3, "High", C2, "T1071.001",
             "Shell or proxy binary reaching the web",
             ends("image", "cmd.exe", "mshta.exe", "rundll32.exe", "regsvr32.exe", "msiexec.exe"),
             OUTBOUND, web),
        rule("NET_SUSPICIOUS_PORT_001", 3, "High", C2, "T1571", "Outbound to a port attack tools favour",
             OUTBOUND,
             matches("destination_port", "^(4444|1337|8888|9999|31337|4545|6666|7777|55555|1234|12345"
                                         "|65535|2222|3333)$")),
        rule("NET_LOLBIN_NETWORK_001", 3, "High", C2, "T1105", "Proxy binary on the network",
             ends("image", "mshta.exe", "regsvr32.exe", "msiexec.exe", "installutil.exe", "cmstp.exe",
                  "odbcconf.exe", "regasm.exe", "regsvcs.exe"),
             OUTBOUND),
        rule("NET_SMB_LATERAL_001", 3, "High", "Lateral Movement", "T1021.002",
             "File sharing started by a user program",
             OUTBOUND, matches("destination_port", "^(445|139)$"),
             lacks("image", "system", "svchost.exe", "lsass.exe", "services.exe", "msmpeng.exe",
                   "wmiprvse.exe")),
        rule("NET_DNS_LONG_QUERY_001", 22, "Medium", C2, "T1071.004", "Very long name lookup",
             matches("query_name", ".{50,}"),
             not_ending("image", "chrome.exe", "msedge.exe", "firefox.exe", "iexplore.exe", "brave.exe",
                        "SearchApp.exe", "msmpeng.exe", "svchost.exe")),
        rule("NET_DNS_SCRIPT_ENGINE_001", 22, "High", C2, "T1071.004", "Name lookup by a script engine",
             ends("image", *SCRIPT_ENGINES)),
        rule("NET_SCRIPT_ENGINE_OUTBOUND_001", 3, "High", C2, "T1071.001", "Script engine on the network",
             ends("image", "\\wscript.exe", "\\cscript.exe", "\\mshta.exe"), OUTBOUND),
    ]


def _parent_child() -> list[Rule]:
    def chain(rule_id, severity, tactic, technique, text, *conds):
        return rule(rule_id, 1, severity, tactic, technique, text, *conds)

    return [
        chain("CHAIN_OFFICE_POWERSHELL_001", "High", ACCESS, "T1566.001", "Office program starts PowerShell",
              has("parent_image", *OFFICE), POWERSHELL),
        chain("CHAIN_OFFICE_CMD_001", "High", ACCESS, "T1566.001", "Office program starts a command shell",
              has("parent_image", *OFFICE), ends("image", "cmd.exe")),
        chain("CHAIN_SCRIPT_HOST_CMD_001", "High", EXECUTION, "T1059.005", "Script host starts a command shell",
              has("parent_image", *SCRIPT_HOSTS), ends("image", "cmd.exe")),
        chain("CHAIN_SCRIPT_HOST_POWERSHELL_001", "High", EXECUTION, "T1059.005", "Script host starts PowerShell",
              has("parent_image", *SCRIPT_HOSTS), POWERSHELL),
        chain("CHAIN_BROWSER_SHELL_001", "High", EXECUTION, "T1059.001", "Browser starts a shell or script",
              has("parent_image", "chrome.exe", "msedge.exe", "firefox.exe", "iexplore.exe", "brave.exe",
                  "opera.exe", "microsoftedge.exe"),
              ends("image", *SHELLS, "mshta.exe")),
        chain("CHAIN_OFFICE_WSCRIPT_001", "High", EXECUTION, "T1059.005", "Office program starts a script host",
              has("parent_image", *OFFICE), ends("image", *SCRIPT_HOSTS)),
        chain("CHAIN_REGSVR32_CHILD_001", "High", EVASION, "T1218.010", "regsvr32 starts a shell or script",
              ends("parent_image", "regsvr32.exe"), ends("image", *SHELLS, "mshta.exe")),
        chain("CHAIN_SCHEDULED_TASK_SCRIPT_001", "Medium", PERSISTENCE, "T1053.005",
              "Task host runs a script from a user folder",
              has("parent_image", *TASK_HOSTS), ends("image", *TASK_SCRIPTS),
              has("command_line", "C:\\Users\\", "C:\\ProgramData\\", "C:\\Windows\\Temp\\",
                  "C:\\Windows\\Tasks\\", "C:\\PerfLogs\\", "AppData\\"),
              lacks_one("command_line", "C:\\Windows\\system32\\")),
        chain("CHAIN_SCHEDULED_TASK_SVCHOST_001", "Medium", PERSISTENCE, "T1053.005",
              "Task service runs a script with download markers",
              has("parent_image", "svchost.exe"), has("parent_command_line", "-s Schedule"),
              ends("image", *TASK_SCRIPTS),
              has("command_line", "http://", "https://", "-enc", "-encoded", "downloadstring", "iex",
                  "invoke-expression", "frombase64string")),
        chain("CHAIN_LOLBIN_CHILD_001", "High", EVASION, "T1218", "Proxy binary starts a shell or script",
              ends("parent_image", "mshta.exe", "rundll32.exe", "odbcconf.exe", "cmstp.exe",
                   "installutil.exe", "regasm.exe", "regsvcs.exe"),
              ends("image", *SHELLS)),
    ]


def _powershell() -> list[Rule]:
    def ps(rule_id, severity, tactic, technique, text, *conds):
        return rule(rule_id, 1, severity, tactic, technique, text, POWERSHELL, *conds)

    def says(*markers):
        return has("command_line", *markers)

    return [
        ps("PS_ENCODED_CMD_001", "High", EXECUTION, "T1059.001", "PowerShell with an encoded command",
           says("-EncodedCommand", "-enc ", "-ec ")),
        ps("PS_DOWNLOAD_CRADLE_001", "High", EXECUTION, "T1059.001", "PowerShell fetching content",
           says("DownloadString", "DownloadFile", "WebClient", "Invoke-WebRequest", "iwr ", "curl ", "wget "),
           lacks("parent_image", "explorer.exe", *TASK_HOSTS, "svchost.exe", null_ok=True)),
        ps("PS_AMSI_BYPASS_001", "High", EVASION, "T1562.001", "PowerShell tampering with AMSI",
           says("amsiInitFailed", "AmsiScanBuffer", "AmsiUtils", "amsi.dll")),
        ps("PS_HIDDEN_WINDOW_001", "Medium", EXECUTION, "T1059.001", "PowerShell in a hidden window",
           says("-WindowStyle Hidden", "-W Hidden", "-WindowStyle H"),
           lacks("parent_image", *TASK_HOSTS, "svchost.exe", null_ok=True)),
        ps("PS_EXECUTION_POLICY_BYPASS_001", "Medium", EXECUTION, "T1059.001", "PowerShell with policy off",
           says("-executionpolicy bypass", "-ep bypass", "-executionpolicy unrestricted")),
        ps("PS_INVOKE_EXPRESSION_001", "High", EXECUTION, "T1059.001", "PowerShell evaluating fetched text",
           says("invoke-expression", "iex(", "iex (", "|iex", "| iex", ".invoke()"),
           says("frombase64string", "downloadstring", "net.webclient", "webclient", "downloadfile",
                "net.sockets", "[char[]")),
        ps("PS_VERSION_DOWNGRADE_001", "High", EVASION, "T1059.001", "PowerShell forced to version 2",
           says("-version 2", "-version 2.0", "-v 2", "-ve 2")),
        ps("PS_REFLECTIVE_ASSEMBLY_001", "High", EVASION, "T1620", "PowerShell loading an assembly from memory",
           says("[system.reflection.assembly]::load", "[reflection.assembly]::load",
                "[reflection.assembly]::loadfile", "assembly]::loadfrom", "loadwithpartialname",
                "[system.reflection.assembly]::loadfile")),
        ps("PS_CREDENTIAL_ACCESS_001", "Critical", "Credential Access", "T1003.001",
           "PowerShell with credential tool words",
           says("invoke-mimikatz", "sekurlsa", "lsadump", "out-minidump", "get-passhashes",
                "invoke-credentialinjection", "mimikatz", "privilege::debug", "invoke-dcsync", "dumpcreds")),
        ps("PS_CONSTRAINED_LANG_BYPASS_001", "High", EVASION, "T1562.001", "PowerShell leaving constrained mode",
           says("__pslockdownpolicy", "pslockdownpolicy")),
        ps("PS_WMI_EXEC_001", "High", EXECUTION, "T1047", "PowerShell working through WMI",
           says("win32_process", "invoke-wmimethod", "get-wmiobject", "gwmi",
                "new-object system.management", "managementobject", "[wmiclass]", "wmic")),
    ]


@cache
def catalogue() -> tuple[Rule, ...]:
    """All shipped rules, by id."""
    rules = _api_memory() + _proxy_binaries() + _network() + _parent_child() + _powershell()
    return tuple(sorted(rules, key=lambda r: r.id))
