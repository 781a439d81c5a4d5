"""Words of English origin in Bengali script."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Surface forms and the English words that they stand for.
BORROWED = (
    ("ফরম", "form"),
    ("ফর্ম", "form"),
    ("ফোন", "phone"),
    ("মোবাইল", "mobile"),
    ("ল্যাপটপ", "laptop"),
    ("কম্পিউটার", "computer"),
    ("ক্যামেরা", "camera"),
    ("কেমেরা", "camera"),
    ("ভিডিও", "video"),
    ("অডিও", "audio"),
    ("চ্যানেল", "channel"),
    ("কমেন্ট", "comment"),
    ("শেয়ার", "share"),
    ("শেয়ার", "share"),
    ("লাইভ", "live"),
    ("স্ট্রিম", "stream"),
    ("কনটেন্ট", "content"),
    ("কন্টেন্ট", "content"),
    ("ক্রিয়েটর", "creator"),
    ("ক্রিয়েটর", "creator"),
    ("ব্লগ", "blog"),
    ("ভ্লগ", "vlog"),
    ("অফিস", "office"),
    ("স্কুল", "school"),
    ("কলেজ", "college"),
    ("ইউনিভার্সিটি", "university"),
    ("ক্লাস", "class"),
    ("ফাইল", "file"),
    ("আপলোড", "upload"),
    ("ডাউনলোড", "download"),
    ("সাবমিট", "submit"),
    ("মিটিং", "meeting"),
    ("ইন্টারভিউ", "interview"),
    ("প্রজেক্ট", "project"),
    ("প্রোজেক্ট", "project"),
    ("অ্যাসাইনমেন্ট", "assignment"),
    ("এসাইনমেন্ট", "assignment"),
    ("এক্সাম", "exam"),
    ("রিপোর্ট", "report"),
    ("রিপোট", "report"),
    ("রেজাল্ট", "result"),
    ("জব", "job"),
    ("ক্যারিয়ার", "career"),
    ("ক্যারিয়ার", "career"),
    ("ডেভেলপার", "developer"),
    ("সফটওয়্যার", "software"),
    ("সফটওয়ার", "software"),
    ("ইঞ্জিনিয়ার", "engineer"),
    ("ইঞ্জিনিয়ার", "engineer"),
    ("কোডিং", "coding"),
    ("রিসার্চ", "research"),
    ("ল্যাব", "lab"),
    ("লাইব্রেরি", "library"),
    ("ওয়াইফাই", "wifi"),
    ("ওয়াইফাই", "wifi"),
    ("ইন্টারনেট", "internet"),
    ("গুগল", "google"),
    ("ফেসবুক", "facebook"),
    ("ইউটিউব", "youtube"),
    ("ইনস্টাগ্রাম", "instagram"),
    ("টিকটক", "tiktok"),
    ("অ্যাপ", "app"),
    ("এ্যাপ", "app"),
    ("ডাটা", "data"),
    ("ডেটা", "data"),
    ("সিম", "sim"),
    ("পাসওয়ার্ড", "password"),
    ("পাসওয়ার্ড", "password"),
    ("একাউন্ট", "account"),
    ("অ্যাকাউন্ট", "account"),
    ("ওয়েবসাইট", "website"),
    ("ওয়েবসাইট", "website"),
    ("লিংক", "link"),
    ("নোটিফিকেশন", "notification"),
    ("হোয়াটসঅ্যাপ", "whatsapp"),
    ("হোয়াটসঅ্যাপ", "whatsapp"),
    ("মেসেঞ্জার", "messenger"),
    ("টেলিগ্রাম", "telegram"),
    ("জুম", "zoom"),
    ("ইমেইল", "email"),
    ("চার্জার", "charger"),
    ("হেডফোন", "headphone"),
    ("স্পিকার", "speaker"),
    ("স্ক্রিন", "screen"),
    ("সেলফি", "selfie"),
    ("স্ক্রিনশট", "screenshot"),
    ("ব্যাংক", "bank"),
    ("লোন", "loan"),
    ("পেমেন্ট", "payment"),
    ("ট্রানজেকশন", "transaction"),
    ("বিকাশ", "bkash"),
    ("নগদ", "nagad"),
    ("রকেট", "rocket"),
    ("রিচার্জ", "recharge"),
    ("ব্যালেন্স", "balance"),
    ("ট্রান্সফার", "transfer"),
    ("ক্যাশ", "cash"),
    ("ক্রেডিট", "credit"),
    ("ডেবিট", "debit"),
)


def borrowed_map() -> Column:
    """Map literal of surface form to English word, at the place of a surface's first entry the word of its last."""
    return F.create_map(*(F.lit(x) for pair in dict(BORROWED).items() for x in pair))
