"""Part numbers, software versions and lifecycle states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States in the order of the breakdown.
STATES = ["End-of-Support", "Approaching EoS", "End-of-Sale", "Current", "Not in EOX", "No Platform ID", "No Data"]
SUPPORT, APPROACHING, SALE, CURRENT, UNLISTED, NO_PID, NO_DATA = STATES
#: Days before the last date of support from which it counts as near, and days that a looked-up record is good for.
NEAR_DAYS, TTL_DAYS = 365, 7
# Software families by device type.
OS_TYPES = {"cisco_ios": "IOS", "cisco_xe": "IOS-XE", "cisco_nxos": "NX-OS", "cisco_xr": "IOS XR", "cisco_asa": "ASA", "cisco_wlc": "WLC"}

# Patterns of part numbers and names.
CHASSIS = r"(?i)^(WS-C\d|C9[2-6]\d{2}[LX]?-\d|CISCO\d|ISR\d.*/K9|VG[23]\d{2}|ASR\d|N[579]K-C\d|NCS-\d)"
CHASSIS_MODEL = r"(?i)^(WS-C\d|C9[2-6]\d{2}[LX]?-\d|CISCO\d|ISR\d.*/K9|VG[23]\d{2})"
NOT_A_MODULE = r"(?i)(stack|PVDM|GBIC|built-in|onboard.*voice|ISR\d{4}\S*-\d+x\d+GE)"
SLOT = r"(?i)^\s*(module\s+)?slot\s+\d"
CONSUMABLE = r"(?i)(^|[\x08_\-])(fan|power|psu|sfp|transceiver|xcvr|cwdm|dwdm|gbic)($|[\x08_\-])"
INLINE = r"(?i)^ISR\d+[A-Z0-9\-]*-\d+x\d+GE$"
MAC_OR_IP = r"(?i)^([0-9a-f]{4}\.){2}[0-9a-f]{4}$|^([0-9a-f]{2}:){5}[0-9a-f]{2}$|^\d{1,3}(\.\d{1,3}){3}$"
# Inventory items that are no components.
SKIPPED = ["fan", "power supply", "psu", "sfp", "transceiver", "sensor", "clk", "usb"]


def _matches(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(pattern)), F.lit(False))


def clean_pid(c: Column) -> Column:
    """A part number fit for a look-up; '' for addresses and texts with control characters."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    inner = F.regexp_extract(bare, r"(?i)\(PID:([^)]+)\)", 1)
    return F.when(_matches(bare, r"[\x00-\x1f\x7f]") | _matches(bare, MAC_OR_IP), "").when(inner != "", F.trim(inner)).otherwise(F.trim(F.regexp_replace(bare, r"(?i)^cisco\s+", "")))


def software_version(version: Column, os_type: Column) -> Column:
    """A version as look-ups know it: without the sub-release of NX-OS, or the letters of IOS."""
    nxos = F.regexp_replace(version, r"^(\d+\.\d+\(\d+\)\w+)\(\d+\)$", "$1")
    ios = F.regexp_replace(F.regexp_replace(version, r"\((\d+)[A-Za-z]\)", "($1)"), r"([A-Z]+\d+)[a-z]$", "$1")
    return F.when(os_type == "NX-OS", nxos).otherwise(ios)


def os_type(device_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in OS_TYPES.items() for x in pair])
    return F.try_element_at(table, device_type)


def day(c: Column) -> Column:
    bare = F.trim(c)
    return F.when(F.regexp_like(bare, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}$")), F.try_to_date(bare, "yyyy-M-d"))


def days_left(support: Column, as_of: Column) -> Column:
    return F.datediff(day(support), as_of)


def state(known: Column, unlisted: Column, no_pid: Column, support: Column, sale: Column, as_of: Column) -> Column:
    """The lifecycle state of a record: known says whether there is one."""
    left, sold = days_left(support, as_of), day(sale) <= as_of
    return (
        F.when(F.coalesce(no_pid, F.lit(False)), NO_PID)
        .when(~F.coalesce(known, F.lit(False)), NO_DATA)
        .when(F.coalesce(unlisted, F.lit(False)), UNLISTED)
        .when(left < 0, SUPPORT)
        .when(left <= NEAR_DAYS, APPROACHING)
        .when(sold, SALE)
        .otherwise(CURRENT)
    )


def is_chassis(pid: Column) -> Column:
    return _matches(pid, CHASSIS)


def is_slot(name: Column) -> Column:
    return _matches(name, SLOT)


def is_consumable(name: Column, description: Column, pid: Column) -> Column:
    return _matches(pid, INLINE) | _matches(name, CONSUMABLE) | _matches(description, CONSUMABLE) | _matches(pid, CONSUMABLE)


def is_module(model: Column, kind: Column) -> Column:
    """Whether a module is a line card, not a chassis, a stack or a built-in part."""
    return ~_matches(model, CHASSIS_MODEL) & ~_matches(model, NOT_A_MODULE) & ~_matches(kind, NOT_A_MODULE)


def is_component(name: Column, description: Column) -> Column:
    """Whether an inventory item is a component of its own."""
    low_name, low = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    skipped = F.exists(F.array(*[F.lit(x) for x in SKIPPED]), lambda x: F.contains(low, x) | F.contains(low_name, x))
    return ~skipped & ~F.contains(low_name, F.lit("chassis"))
