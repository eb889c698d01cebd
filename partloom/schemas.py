"""Fixed schemas: catalogue tables, wide catalogue and the 25 spec layouts."""

from __future__ import annotations

from typing import NamedTuple

# Column names and order of the catalogue tables.
TABLE_DDL = {
    "manufacturer": "producator_id long, nume string, tara string, website string",
    "category": "categorie_id long, nume string, descriere string",
    "standard": "standard_id long, grup string, cod string, descriere string",
    "product": (
        "produs_id long, cod_sku string, denumire string, categorie_id long, "
        "producator_id long, garantie_luni int, status string"
    ),
    "product_standard": "produs_id long, standard_id long",
    "warehouse": "depozit_id long, nume string, oras string, tara string",
    "stock": "produs_id long, depozit_id long, cantitate long, prag_minim long",
    "customer": (
        "client_id long, tip string, nume string, cod_fiscal string, tara string, "
        "categoria_pret string"
    ),
    "sales_order": (
        "cv_id long, client_id long, data_creare timestamp, status string, metoda_livrare string"
    ),
    "order_line": (
        "cv_linie_id long, cv_id long, linie_nr int, produs_id long, cantitate long, "
        "pret_unitar decimal(12,2), discount decimal(5,4)"
    ),
    "shipment": (
        "expediere_id long, cv_id long, depozit_id long, curier string, awb string, "
        "data_expediere timestamp"
    ),
    "rma": (
        "rma_id long, client_id long, produs_id long, cv_id long, motiv string, status string, "
        "data_creare timestamp"
    ),
}

# The names under which users address the tables in SQL.
SQL_NAMES = {
    "manufacturer": "PRODUCATOR",
    "category": "CATEGORIE",
    "standard": "STANDARD",
    "product": "PRODUS",
    "product_standard": "PRODUS_STANDARD",
    "warehouse": "DEPOZIT",
    "stock": "STOC",
    "customer": "CLIENT",
    "sales_order": "COMANDA_VANZARE",
    "order_line": "CV_LINIE",
    "shipment": "EXPEDIERE",
    "rma": "RMA",
}

# Column order of the wide catalogue.
WIDE_COLUMNS = (
    "cod_sku",
    "denumire",
    "categorie",
    "producator",
    "garantie_luni",
    "status",
    "depozit",
    "oras_depozit",
    "tara_depozit",
    "cantitate",
    "prag_minim",
    "socket",
    "memory_type",
    "form_factor",
    "interface",
    "storage_form",
)
WIDE_INTEGERS = ("garantie_luni", "cantitate", "prag_minim")
WIDE_DDL = ", ".join(f"{c} {'int' if c in WIDE_INTEGERS else 'string'}" for c in WIDE_COLUMNS)

# Wide columns that a raw file supplies.
RESOLVED_COLUMNS = (
    "cod_sku",
    "denumire",
    "categorie",
    "producator",
    "socket",
    "memory_type",
    "form_factor",
    "interface",
    "storage_form",
)

# Raw column to standard group, later rows win.
STANDARDS_MAP = {
    "socket": "SOCKET_CPU",
    "cpu_socket": "SOCKET_CPU",
    "processor_socket": "SOCKET_CPU",
    "memory_type": "MEM_TYPE",
    "ram_type": "MEM_TYPE",
    "memory": "MEM_TYPE",
    "form_factor": "FORM_FACTOR_MB",
    "mb_form_factor": "FORM_FACTOR_MB",
    "interface": "INTERFATA",
    "bus": "INTERFATA",
    "storage_form": "STORAGE_FORM",
    "m2": "STORAGE_FORM",
}

RAW_SPEC_DDL = (
    "category string, item_id long, name string, price_text string, position int, "
    "label string, value string"
)

# Category, label on the page, field, decoding rule.
SPEC_MAP_TEXT = """
cpu | Core Count | core_count | number
cpu | Performance Core Clock | core_clock | number
cpu | Performance Core Boost Clock | boost_clock | number
cpu | Microarchitecture | microarchitecture | token
cpu | TDP | tdp | number
cpu | Integrated Graphics | graphics | token
cpu | SMT | smt | flag
cpu-cooler | Fan RPM | rpm | number
cpu-cooler | Noise Level | noise_level | number
cpu-cooler | Color | color | token
cpu-cooler | Radiator Size | size | number
motherboard | Socket / CPU | socket | token
motherboard | Form Factor | form_factor | token
motherboard | Memory Max | max_memory | number
motherboard | Memory Slots | memory_slots | number
motherboard | Color | color | token
memory | Speed | speed | number
memory | Modules | modules | number
memory | Price / GB | price_per_gb | number
memory | Color | color | token
memory | First Word Latency | first_word_latency | number
memory | CAS Latency | cas_latency | number
internal-hard-drive | Capacity | capacity | capacity
internal-hard-drive | Price / GB | price_per_gb | number
internal-hard-drive | Type | type | drive_type
internal-hard-drive | Cache | cache | number
internal-hard-drive | Form Factor | form_factor | drive_form
internal-hard-drive | Interface | interface | token
video-card | Chipset | chipset | token
video-card | Memory | memory | number
video-card | Core Clock | core_clock | number
video-card | Boost Clock | boost_clock | number
video-card | Color | color | token
video-card | Length | length | number
case | Type | type | token
case | Color | color | token
case | Power Supply | psu | number
case | Side Panel | side_panel | token
case | External Volume | external_volume | number
case | Internal 3.5" Bays | internal_35_bays | number
power-supply | Type | type | token
power-supply | Efficiency Rating | efficiency | efficiency
power-supply | Wattage | wattage | number
power-supply | Modular | modular | token
power-supply | Color | color | token
os | Mode | mode | number
os | Maximum Supported Memory | max_memory | number
monitor | Screen Size | screen_size | number
monitor | Resolution | resolution | number
monitor | Refresh Rate | refresh_rate | number
monitor | Response Time (G2G) | response_time | number
monitor | Panel Type | panel_type | token
monitor | Aspect Ratio | aspect_ratio | token
sound-card | Channels | channels | number
sound-card | Digital Audio | digital_audio | number
sound-card | SNR | snr | number
sound-card | Sample Rate | sample_rate | number
sound-card | Chipset | chipset | token
sound-card | Interface | interface | token
wired-network-card | Interface | interface | token
wired-network-card | Color | color | token
wireless-network-card | Protocol | protocol | token
wireless-network-card | Interface | interface | token
wireless-network-card | Color | color | token
headphones | Type | type | token
headphones | Frequency Response | frequency_response | number
headphones | Microphone | microphone | flag
headphones | Wireless | wireless | flag
headphones | Enclosure Type | enclosure_type | token
headphones | Color | color | token
keyboard | Style | style | token
keyboard | Switch Type | switches | token
keyboard | Backlit | backlit | token
keyboard | Tenkeyless | tenkeyless | flag
keyboard | Connection Type | connection_type | token
keyboard | Color | color | token
mouse | Tracking Method | tracking_method | token
mouse | Connection Type | connection_type | token
mouse | Maximum DPI | max_dpi | number
mouse | Hand Orientation | hand_orientation | token
mouse | Color | color | token
speakers | Configuration | configuration | number
speakers | Total Wattage | wattage | number
speakers | Frequency Response | frequency_response | number
speakers | Color | color | token
webcam | Resolution | resolutions | list
webcam | Connection | connection | token
webcam | Focus Type | focus_type | token
webcam | Operating System | os | list
webcam | FOV Angle | fov | number
case-accessory | Type | type | token
case-accessory | Form Factor | form_factor | number
case-fan | Size | size | number
case-fan | Color | color | token
case-fan | RPM | rpm | number
case-fan | Airflow | airflow | number
case-fan | Noise Level | noise_level | number
case-fan | PWM | pwm | flag
fan-controller | Channels | channels | number
fan-controller | Channel Wattage | channel_wattage | number
fan-controller | PWM (4-Pin) | pwm | flag
fan-controller | Form Factor | form_factor | number
fan-controller | Color | color | token
thermal-paste | Amount | amount | number
external-hard-drive | Type | type | token
external-hard-drive | Interface | interface | token
external-hard-drive | Capacity | capacity | number
external-hard-drive | Price / GB | price_per_gb | number
external-hard-drive | Color | color | token
optical-drive | BD | bd | number
optical-drive | DVD | dvd | number
optical-drive | CD | cd | number
optical-drive | BD Write | bd_write | token
optical-drive | DVD Write | dvd_write | token
optical-drive | CD Write | cd_write | token
ups | Capacity (W) | capacity_w | number
ups | Capacity (VA) | capacity_va | number
"""


class SpecField(NamedTuple):
    """One labelled value of a part category and how its text is decoded."""

    category: str
    label: str
    field: str
    rule: str


SPEC_MAP = tuple(
    SpecField(*(cell.strip() for cell in line.split(" | ")))
    for line in SPEC_MAP_TEXT.strip().splitlines()
)
SPEC_CATEGORIES = tuple(dict.fromkeys(f.category for f in SPEC_MAP))

# Spark type a rule yields; "mixed" fields get a text and a numbers column.
RULE_KINDS = {
    "number": "numbers",
    "capacity": "numbers",
    "token": "text",
    "efficiency": "text",
    "flag": "boolean",
    "list": "items",
    "drive_type": "mixed",
    "drive_form": "mixed",
}


def spec_layout(category: str) -> tuple[SpecField, ...]:
    """Fields of a category in record order."""
    fields = tuple(f for f in SPEC_MAP if f.category == category)
    if not fields:
        raise ValueError(f"unknown part category: {category}")
    return fields
