"""The fold over hand-made spans."""

import pytest

from nameloom.operators.fold import converted, fold




def spans_of(name, *tokens):
    data = name.encode()
    return [(t, data.find(x.encode()), data.find(x.encode()) + len(x.encode())) for t, x in tokens]



M, Y, R, S, E, SE = "MAIN", "year", "resolution", "season_marker", "episode_marker", "season_episode_marker"
CASES = [
    ("Movie.2024.2160p.UHD.AMZN.WEB-DL.HEVC.10bit.DV.DDP.5.1.Atmos-GROUP.mkv",
     [(M, "Movie"), (Y, "2024"), (R, "2160p"), ("source_type", "UHD"), ("platform", "AMZN"), ("source_type", "WEB-DL"), ("codec", "HEVC"), ("bit_depth", "10bit"), ("hdr", "DV"), ("audio_codec", "DDP"), ("audio_channels", "5.1"), ("audio_feature", "Atmos"), ("release_group", "GROUP"), ("file_extension", "mkv")],
     dict(content="movie", anime="False", numbering="none", pack_scope="single", special="movie"),
     dict(valid=True, title="Movie", year=2024, screen_size="2160p", source="WEB-DL", streaming_service="AMZN", video_codec="HEVC", ten_bit=True, dolby_vision=True, hdr="DV", audio_codec="DDP", audio_channels="5.1", audio_profile="Atmos", release_group="GROUP", container="mkv", medium="video", specials=False, n_origins=19)),
    ("Show.S00.E01-E03.Complete", [(M, "Show"), (S, "S00"), (E, "E01-E03"), ("pack_marker", "Complete")], dict(numbering="absolute", pack_scope="complete"),
     dict(season=0, absolute_episode=1, absolute_episode_end=3, episode=None, episode_end=None, episode_count=3, pack=True, complete_range=True, numbering="absolute")),
    ("Show Name 804 vostfr HD", [(M, "Show Name"), (SE, "804"), ("subtitle_language", "vostfr")], dict(numbering="absolute"), dict(season=8, episode=4, absolute_episode=None, numbering="season_episode", subtitle_languages=["fra"])),
    ("El Pueblo Cap.301 HDTV", [(M, "El Pueblo"), (SE, "Cap.301"), ("source_type", "HDTV")], dict(numbering="season_episode"), dict(season=3, episode=1, episode_end=None, pack=False, source="HDTV")),
    ("El Pueblo Cap.301_302 HDTV", [(M, "El Pueblo"), (SE, "Cap.301_302")], {}, dict(season=3, episode=1, episode_end=2, pack=True)),
    ("Show 2x11 HDTV", [(M, "Show"), (E, "2x11")], {}, dict(season=2, episode=11, episode_end=None, pack=False)),
    ("Show Series 7 04of10", [(M, "Show"), (S, "Series 7"), (E, "04of10")], {}, dict(season=7, episode=4, episode_end=None, pack=False)),
    ("Title.MYSTERY", [(M, "Title"), ("codec", "MYSTERY")], {}, dict(n_origins=2, video_codec=None)),
    ("Movie.2024.Ai-Enhanced.HEVC", [(M, "Movie"), (Y, "2024"), ("edition", "Ai-Enhanced")], {}, dict(ai_upscale=True, edition_origin="ai upscale")),
    ("Movie.2024.AI增强.HEVC", [(M, "Movie"), ("edition", "AI增强")], {}, dict(ai_upscale=True)),
    ("Movie.2024.REPACK.HEVC", [(M, "Movie"), ("edition", "REPACK")], {}, dict(ai_upscale=False, repack=True, revision_version=2)),
    ("Movie.2024.PROPER2.REAL.REAL.v3-GRP", [(M, "Movie"), ("edition", "PROPER2.REAL.REAL")], {}, dict(proper=True, revision_real=2, revision_version=3)),
    ("Rush.Hour.2160p.Hybrid.HDR10", [(M, "Rush.Hour"), (R, "2160p"), ("source_type", "Hybrid")], {}, dict(hybrid=True, source=None)),
    ("[K] One Piece 1072 [VERSION_LIGHT][1920x1080]", [(M, "One Piece"), ("edition", "VERSION_LIGHT")], {}, dict(light_encode=True, edition_origin="light encode")),
    ("Movie.2019.MicroHD.1080p.x264-GRP", [(M, "Movie"), ("source_type", "MicroHD")], {}, dict(light_encode=True)),
    ("Example.Movie.2024.3D.Half-SBS.1080p", [(M, "Example.Movie"), ("crc32", "3D"), ("crc32", "Half-SBS"), (R, "1080p")], {}, dict(three_d=True, screen_size="1080p", crc32=None)),
    ("Show.S01E01.1080p-GRP.[ABCD1234]", [(M, "Show"), ("crc32", "ABCD1234")], {}, dict(three_d=False, crc32="ABCD1234", season=1, episode=1)),
    ("[Pn8] Date A Live S02 [1080p] [Dub]", [("release_group", "Pn8"), (M, "Date A Live"), (S, "S02"), (R, "1080p"), ("audio_language", "Dub")], {}, dict(english_dub=True, languages=[], audio_origin="english dub")),
    ("Show.S01.German.DL.1080p-GRP", [(M, "Show"), ("audio_language", "German")], {}, dict(english_dub=False, languages=["deu"])),
    ("Example.Movie.2024.4k.to.1080p.WEBRip.x265-GRP", [(M, "Example.Movie"), (R, "4k"), (R, "1080p")], {}, dict(downscaled=True, screen_size="1080p")),
    ("Example.Movie.2024.4k.to.1080p.WEBRip.x265-GRP", [(M, "Example.Movie"), (R, "4k.to"), (R, "1080p")], {}, dict(downscaled=True, screen_size="1080p")),
    ("Example.Movie.2024.2160p.1080p.WEBRip-GRP", [(M, "Example.Movie"), (R, "2160p"), (R, "1080p")], {}, dict(downscaled=False, screen_size="2160p")),
    ("[SubsPlease] Replica Date. (01-13) (1080p)", [(M, "Replica Date"), (E, "01-13")], dict(numbering="absolute"), dict(absolute_episode=1, absolute_episode_end=13, episode_count=13, pack=True, complete_range=True)),
    ("[Group] Show (01-03) (1080p)", [(M, "Show"), (E, "01-03")], {}, dict(complete_range=False)),
    ("Show.E01-E13.1080p", [(M, "Show"), (E, "E01-E13")], {}, dict(complete_range=False, episode_end=13)),
    ("[Y] KOWLOON - S01 [English Dub]", [(M, "KOWLOON"), ("audio_language", "English Dub")], {}, dict(english_dub=True, languages=["eng"])),
    ("Show.S01.1080p.GerDub.WEB-GRP", [(M, "Show"), ("audio_language", "GerDub")], {}, dict(english_dub=False, languages=["deu"])),
    ("Example.Movie.2024.3D.Half-SBS.1080p.BluRay", [(M, "Example.Movie"), (Y, "2024"), (R, "1080p")], {}, dict(three_d=True)),
    ("3D.Kanojo.Real.Girl.S01E01.1080p", [(M, "3D.Kanojo.Real.Girl"), (R, "1080p")], {}, dict(three_d=False)),
    ("[Pn8] Date A Live S02 [Funi-DL] [1080p] [Dub]", [(M, "Date A Live"), (S, "S02")], {}, dict(english_dub=True, audio_origin="english dub")),
    ("[Grp] (Dub) Chronicles S01E01 [1080p]", [(M, "(Dub) Chronicles"), (SE, "S01E01")], {}, dict(english_dub=False)),
    ("Show S01E03 MULTi AAC2.0 (Alt, Multi-Audio, Multi-Subs)", [(M, "Show"), ("dual_audio_tag", "MULTi"), ("dual_audio_tag", "Multi-Audio")], {}, dict(multi_audio=True, dual_audio=False)),
    ("Show S01E03 DUAL AAC2.0", [(M, "Show"), ("dual_audio_tag", "DUAL")], {}, dict(multi_audio=False, dual_audio=True)),
    ("Show S01E03 1080p", [(M, "Show"), (SE, "S01E03")], dict(pack_scope="season"), dict(pack=False, pack_scope="single", season=1, episode=3)),
    ("Show S01E01 Batch 1080p", [(M, "Show"), (SE, "S01E01"), ("pack_marker", "Batch")], dict(pack_scope="season"), dict(pack=True, pack_scope="season")),
    ("Show S01 1080p", [(M, "Show"), (S, "S01")], dict(pack_scope="season"), dict(pack=True)),
    ("[I] Kowloon Generic Romance - S01", [("ALT", "Kowloon Generic Romance"), (S, "S01")], {}, dict(title="Kowloon Generic Romance", alternative_titles=[], title_origin="Kowloon Generic Romance")),
    ("Swallowed.Star.S01E001-S04E143.x265", [(M, "Swallowed.Star"), (S, "S01"), (E, "E001"), (S, "S04"), (E, "E143")], dict(pack_scope="single"), dict(pack=True, season=1, season_end=4, episode=1, episode_end=143, episode_count=143, episode_confidence=0.75)),
    ("Wonderland.S01E001-S05E267.(443).(EFC)", [(M, "Wonderland"), (SE, "S01E001"), (SE, "S05E267")], {}, dict(season_end=5, episode=None)),
    ("American_Dad_S01E01-S03E12", [(M, "American_Dad"), (S, "S01"), (E, "E01"), (S, "S03"), (E, "E12")], {}, dict(pack=True, season=1, season_end=3, episode=None)),
    ("Survivor.S36E01-S36E02.720p", [(M, "Survivor"), (SE, "S36E01"), (E, "S36E02")], {}, dict(season=36, season_end=None, episode=1, episode_end=2, episode_count=2, pack=True)),
    ("Another Life (2019) S01E01 To S01E03 720p", [(M, "Another Life"), (Y, "2019"), (SE, "S01E01"), (SE, "S01E03")], {}, dict(episode=1, episode_end=3, year=2019)),
    ("Clarissa.S05E11.bis.S05E13.GERMAN", [(M, "Clarissa")], {}, dict(season=5, episode=11, episode_end=13)),
    ("NCIS Complete pack from s01e01 to s11e17", [(M, "NCIS")], {}, dict(season=1, season_end=11, episode=None)),
    ("Thomas.and.Friends.S19E09_S20E14.CONVERT", [(M, "Thomas.and.Friends"), (SE, "S19E09"), (SE, "S20E14")], {}, dict(season=19, season_end=None)),
    ("Antiques Road Trip S15E05-S14E10", [(M, "Antiques Road Trip"), (SE, "S15E05"), (E, "S14E10")], {}, dict(season=15, episode=5, episode_end=None, season_end=None)),
    ("Show.E01.E02.E03.E07", [(M, "Show"), (E, "E01"), (E, "E02"), (E, "E03"), (E, "E07")], {}, dict(episode=1, episode_end=3, episode_count=3, pack=True)),
    ("Movie.2049.1080p", [(M, "Movie"), (Y, "2049"), (R, "1080p")], {}, dict(title="Movie 2049", year=None)),
    ("2049.Movie.1080p", [(Y, "2049"), (M, "Movie")], {}, dict(title="2049 Movie", year=None)),
    ("Daily.2023.06.01.Guest", [(M, "Daily"), (Y, "2023.06.01"), ("episode_title", "Guest")], {}, dict(year=2023, date="2023-06-01", episode_title="Guest")),
    ("Movie.UHD.1080p.BluRay", [(M, "Movie"), ("source_type", "UHD"), (R, "1080p"), ("source_type", "BluRay")], {}, dict(screen_size="2160p", source="BluRay")),
    ("Movie.1080p.UHD.BluRay", [(M, "Movie"), (R, "1080p"), ("source_type", "UHD")], {}, dict(screen_size="1080p", source="BluRay")),
    ("Movie.UHDRDV.AAC.Eng.Fre.Ger", [(M, "Movie"), ("source_type", "UHDRDV"), ("audio_codec", "AAC"), ("audio_language", "Eng"), ("audio_language", "Fre"), ("audio_language", "Ger")], {}, dict(hdr="DV", hdr10=True, dolby_vision=True, audio_codec="AAC", languages=["eng", "fra", "deu"], multi_audio=True)),
    ("Movie.IMAX.DC.24bit.x", [(M, "Movie"), ("edition", "DC"), ("edition", "IMAX"), ("bit_depth", "24bit")], {}, dict(editions=["IMAX", "Director's Cut"], edition="IMAX", medium="music")),
    ("Movie.hardsub.no.subs-GRP-GRP2-x265", [(M, "Movie"), ("hardsub_tag", "hardsub"), ("release_group", "GRP"), ("release_group", "GRP2"), ("release_group", "x265")], {}, dict(hard_subs=True, release_groups=["GRP", "GRP2"], release_group="GRP")),
    ("Anything", [], {}, dict(valid=False, title=None, n_origins=0)),
]


@pytest.fixture(scope="module")
def records(spark):
    rows = [(k, c[0], j, t, b, e, 0.9) for k, c in enumerate(CASES) for j, (t, b, e) in enumerate(spans_of(c[0], *c[1]))]
    spans = spark.createDataFrame(rows, "name_id long, name string, ord int, type string, begin int, end int, confidence float")
    verdicts = ["content", "adult", "numbering", "pack_scope", "special", "anime"]
    names = spark.createDataFrame([(k, c[0], *((c[2][v], 0.8) if v in c[2] else None for v in verdicts)) for k, c in enumerate(CASES)], "name_id long, name string, " + ", ".join(f"{v} struct<value:string,confidence:float>" for v in verdicts))
    found = fold(names.join(converted(spans).drop("name"), "name_id", "left"))
    return {r["name_id"]: r for r in found.collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(records, k):
    row = records[k]
    origins = row["origins"]
    extra = {
        "n_origins": len(origins), "date": row["date"] and row["date"].isoformat(),
        "edition_origin": next((o["value"] for o in origins if o["field"] == "edition"), None),
        "audio_origin": next((o["value"] for o in origins if o["field"] == "audio_language"), None),
        "title_origin": next((o["value"] for o in origins if o["field"] == "title"), None),
        "episode_confidence": next((o["confidence"] for o in origins if o["field"] == "episode"), None),
    }
    found = {f: extra[f] if f in extra else row[f] for f in CASES[k][3]}
    assert found == CASES[k][3], CASES[k][0]
