from linkrank.sources import settings


def test_defaults_repairs_and_versions():
    out, save = settings.load(None)
    assert not save and out["debounceMs"] == 350 and out["excludedTags"] == [] and settings.load(out) == (out, False)
    out, save = settings.load({"debounceMs": 9, "maxSuggestions": float("nan"), "excludedTags": [" #Water ", "water", 3], "semanticModelEnabled": True, "linkPathMode": "odd", "minimumConfidence": 7})
    assert save and out["debounceMs"] == 100 and out["maxSuggestions"] == 6 and out["excludedTags"] == ["water"] and not out["semanticModelEnabled"] and out["linkPathMode"] == "shortest" and out["minimumConfidence"] == 1
    assert settings.load({"settingsVersion": 99, "debounceMs": 5})[1] is False and settings.load("text")[1] is True
    tuned = {"semanticThreadMode": "tuned", "semanticThreadCount": 2, "semanticThreadModelRevision": "r", "semanticThreadRuntimeVersion": "v", "semanticThreadDeviceClass": "5-8"}
    assert settings.load(tuned)[0]["semanticThreadCount"] == 2 and settings.load(tuned | {"semanticThreadCount": 3})[0]["semanticThreadMode"] == "automatic"
